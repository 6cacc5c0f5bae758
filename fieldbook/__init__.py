"""fieldbook: notebook-style analytics as Spark DataFrame operations."""
