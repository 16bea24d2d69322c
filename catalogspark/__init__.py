"""Spark-native catalog analytics."""
