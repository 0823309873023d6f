"""Log-sequence anomaly analytics as PySpark DataFrame operations."""
