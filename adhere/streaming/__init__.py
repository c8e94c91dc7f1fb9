"""The edit feed as a stream."""
