"""Spark-native analytics for hourly energy-market tables."""

__version__ = "0.1.0"
