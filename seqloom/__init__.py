"""A Spark-native engine for sensor sequences."""
