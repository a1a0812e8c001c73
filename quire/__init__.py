"""Text analytics and retrieval over books, on Spark."""
