"""Urban air-quality analytics as Spark DataFrame and Structured Streaming jobs."""
