"""News-signal analytics on Spark: validated ingestion, retrieval, reranking, signal aggregation and reports as DataFrame plans."""
