"""variorum: text collation and corpus analytics on Spark DataFrames."""
