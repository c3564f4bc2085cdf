"""Spark-native analytics for daily multi-market price series."""
