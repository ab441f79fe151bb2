"""Flow analytics on Spark."""
