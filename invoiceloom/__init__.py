"""Invoice extraction, checking and scoring as Spark DataFrame jobs."""
