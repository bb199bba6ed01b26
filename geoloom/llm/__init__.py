"""Training-data pipeline operators on Spark."""
