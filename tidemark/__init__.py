"""Event-aligned time-series analytics on Spark."""
