"""tidemark: attention-series, text and training-data analytics expressed as Spark plans."""
