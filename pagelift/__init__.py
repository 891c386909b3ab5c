"""Spark-native web-content extraction: pages in, reviewed Markdown out."""

__version__ = "0.1.0"
