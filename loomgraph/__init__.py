"""Graph layout and graph analytics as PySpark DataFrame jobs."""
