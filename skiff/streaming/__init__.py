"""The byte-stream decoders under Structured Streaming."""
