"""Document retrieval analytics on Spark: ingest, lexical and vector search, fusion and evaluation as DataFrame plans."""
