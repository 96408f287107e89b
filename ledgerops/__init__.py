"""Chain-indexer operations as Spark DataFrame jobs."""
