"""Spark-native analytics over tabular data."""
