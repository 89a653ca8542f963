"""Cell-free-DNA fragment analytics and a sample-by-feature store on Spark DataFrames."""
