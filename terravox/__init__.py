"""Gridded-field and point-site analytics expressed as Spark DataFrame jobs."""
