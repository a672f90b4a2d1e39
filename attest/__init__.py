"""Evidence analytics on Spark: documents to blocks, chunks, retrieval and evaluation."""
