"""Survey-description analytics on Spark."""
