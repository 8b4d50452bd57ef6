"""The batch rules on Structured Streaming, in event time."""
