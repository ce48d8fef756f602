"""Event-time windows and stateful operators for Structured Streaming."""
