"""Document analytics as PySpark plans."""
