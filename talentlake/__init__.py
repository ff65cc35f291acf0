"""talentlake: job-posting analytics as Spark DataFrame operations."""
