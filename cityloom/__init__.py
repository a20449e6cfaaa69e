"""Spark-native engine for city-scale spatial data and training-corpus processing."""
