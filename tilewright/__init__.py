"""Semi-discrete optimal transport and power diagrams on Spark DataFrames."""
