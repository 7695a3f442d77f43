"""The stateless kernels under Structured Streaming."""
