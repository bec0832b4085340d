"""quire: document-corpus building, retrieval and data preparation as Spark DataFrame jobs."""
