"""Spark-native analytics for gridded and point observations."""
