"""Spark-native engine for studying how a community's language and its members change over time."""

__version__ = "0.1.0"
