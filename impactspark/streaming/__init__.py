"""Change capture and the pending queue on Structured Streaming."""
