"""Spark-native analytics for decoded technical drawings."""
