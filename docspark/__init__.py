"""docspark: document retrieval and its analytics as Spark jobs."""
