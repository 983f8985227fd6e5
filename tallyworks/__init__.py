"""Spark-native analytics over step-annotated arithmetic text."""

__version__ = "0.1.0"
