"""The event audit on Structured Streaming."""
