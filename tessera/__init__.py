"""Graph pattern analytics and training-data operators on Spark."""
