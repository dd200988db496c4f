"""Version-history analytics on Spark."""
