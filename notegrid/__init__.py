"""Memory-corpus analytics and training-data operators on Spark."""
