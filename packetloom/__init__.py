"""Spark-native analytics over document packets, their runs and their events."""

__version__ = "0.1.0"
