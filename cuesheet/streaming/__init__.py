"""The row-local part of the engine on Structured Streaming."""
