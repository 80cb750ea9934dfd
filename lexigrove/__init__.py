"""Search and document analytics as plain Spark DataFrame jobs."""
