"""siftmark: retrieval, ranking and evaluation of labelled catalogs on Spark DataFrames."""
