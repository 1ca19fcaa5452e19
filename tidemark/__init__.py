"""tidemark: metocean time-series analytics expressed as Spark plans."""
