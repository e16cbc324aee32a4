"""Document structuring and corpus preparation on Spark."""
