"""tidelog: analytics over ordered, versioned key-value logs, on Spark DataFrames."""
