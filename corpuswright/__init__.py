"""Spark-native preparation and evaluation of multilingual translation data."""
