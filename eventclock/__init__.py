"""Event-clock time-series analytics on PySpark."""
