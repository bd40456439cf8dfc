"""Spark-native retrieval and code-context analytics."""
