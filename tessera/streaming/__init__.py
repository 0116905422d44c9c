"""Statistics that follow a stream."""
