"""Analytics over schemaless key/value records on Spark DataFrames."""
