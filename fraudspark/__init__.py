"""Transaction-monitoring operators for Spark: DataFrames in, DataFrames out."""
