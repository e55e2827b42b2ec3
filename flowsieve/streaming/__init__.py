"""Live detection on Structured Streaming."""
