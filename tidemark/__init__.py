"""tidemark: market data, research and corpus operators as Spark DataFrame functions."""
