"""Live layers: each as a batch expression, and on Structured Streaming."""
