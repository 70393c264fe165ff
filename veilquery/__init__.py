"""Private-selector analytics and training-data preparation on Spark DataFrames."""
