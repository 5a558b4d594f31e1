"""tidemark: feed collection, search and corpus preparation as Spark jobs."""
