"""tidemark: behavioural profiling analytics expressed as Spark DataFrames."""
