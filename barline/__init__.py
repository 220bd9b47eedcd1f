"""Market-data analytics on Spark: long (date, asset) panels in, DataFrames out."""
