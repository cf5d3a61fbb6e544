"""Spark-native analytics engine for document collections and their knowledge graphs."""
