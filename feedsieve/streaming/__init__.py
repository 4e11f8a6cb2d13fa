"""The repeated run, as Structured Streaming."""
