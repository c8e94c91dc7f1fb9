"""Results users see, composed from the operators."""
