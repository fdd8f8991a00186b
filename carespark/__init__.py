"""Healthcare data operators on Spark DataFrames and streams."""
