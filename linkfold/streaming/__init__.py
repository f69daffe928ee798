"""Event-time queries as Structured Streaming, and the same windows over tables."""
