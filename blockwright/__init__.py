"""Spark-native engine for compressed asset analytics."""
