"""Spark-native analytics over labelled 3-D point sets."""
