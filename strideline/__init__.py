"""Spark-native analytics over places, recording sessions and observed people."""
