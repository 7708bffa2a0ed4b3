"""Tidemark: a PySpark-native engine for layered commerce data."""
