"""Spark-native document extraction and text-offset queries."""
