"""Spark-native analytics over property graphs of source code, text and vectors."""
