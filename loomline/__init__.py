"""Spark-native analytics over message and text corpora."""
