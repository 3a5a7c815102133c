"""Event studies over bar series, expressed as Spark DataFrame jobs."""
