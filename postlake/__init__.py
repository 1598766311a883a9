"""Spark-native message and document analytics."""
