"""Market-data analytics on Spark: a typed Parquet lake and DataFrame operators
that handle every symbol of a channel in one plan."""
