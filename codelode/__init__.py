"""codelode: code- and corpus-analytics on Spark DataFrames."""
