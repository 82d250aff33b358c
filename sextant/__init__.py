"""Spark-native signal research engine."""
