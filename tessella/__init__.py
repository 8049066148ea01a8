"""A Spark-native analytics library."""
