"""Session-aligned panel analytics as plain Spark DataFrame jobs."""
