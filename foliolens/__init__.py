"""foliolens: document analytics and retrieval expressed as Spark DataFrames."""
