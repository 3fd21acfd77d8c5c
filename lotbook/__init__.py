"""Spark-native analytics and price models for large tables of priced item listings."""
