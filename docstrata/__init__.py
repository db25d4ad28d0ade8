"""Spark-native analytics for multilingual document collections."""
