"""Plan-versus-actual analytics as Spark jobs."""
