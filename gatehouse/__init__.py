"""Answer-quality and preference-data operators on Spark DataFrames."""
