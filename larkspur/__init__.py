"""Spark-native analytics over collections of text records."""
