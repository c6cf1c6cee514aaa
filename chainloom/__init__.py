"""Spark-native engine for verifiable event histories and their provenance."""

__version__ = "0.1.0"
