"""Reader events with Structured Streaming."""
