"""Point-in-time analytics over corpora of versioned, dated documents, on Spark DataFrames."""
