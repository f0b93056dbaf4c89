"""millrace: content, engagement and parts analytics as plain Spark jobs."""
