"""Block analytics and archival on Spark DataFrames."""
