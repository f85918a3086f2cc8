"""Larkspur: a PySpark-native analytics engine for snapshot histories, as-of replay and evaluation."""
