"""Spark-native analytics over paired before/after image tiles."""
