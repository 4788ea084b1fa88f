"""lingmill: language analytics over Spark DataFrames."""
