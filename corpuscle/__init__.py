"""Spark-native code-corpus analytics and retrieval."""
