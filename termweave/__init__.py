"""Spark-native document translation and terminology analytics."""
