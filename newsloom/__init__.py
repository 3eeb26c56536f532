"""Spark-native extraction, deduplication and training-data engine for news pages."""
