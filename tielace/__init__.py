"""Image-correspondence analytics as PySpark DataFrame jobs."""
