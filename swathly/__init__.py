"""Spark-native analytics for airborne line-scanner data."""
