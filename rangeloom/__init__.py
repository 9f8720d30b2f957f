"""Spark-native analytics over coordinates, strings, statistics and graphs."""
