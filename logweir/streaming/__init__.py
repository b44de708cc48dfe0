"""Following growing logs with Structured Streaming."""
