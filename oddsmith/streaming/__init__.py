"""Season files as a stream."""
