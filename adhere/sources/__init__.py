"""Reading the tables and writing results."""
