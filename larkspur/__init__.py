"""Spark-native document ingestion, retrieval and conversation analytics."""
