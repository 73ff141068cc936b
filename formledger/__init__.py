"""Document-format governance as Spark jobs."""
