"""Content-addressed media analytics expressed as lazy Spark DataFrames."""
