"""paperloom: document intelligence and retrieval analytics on Spark DataFrames."""
