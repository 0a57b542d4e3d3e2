"""Spark-native document analytics, retrieval and answer evaluation."""
