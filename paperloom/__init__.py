"""paperloom: document analytics over Spark DataFrames."""
