"""Walk-forward decision analytics as Spark DataFrame jobs."""
