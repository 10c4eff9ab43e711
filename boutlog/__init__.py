"""Features, evaluation and training-data operators on Spark DataFrames."""
