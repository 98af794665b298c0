"""Tidemark: a Spark-native engine for conversational memory analytics."""

__version__ = "0.1.0"
