"""A Spark-native vertical search and text-data engine."""
