"""Streaming-media telemetry analytics on PySpark."""
