"""A Spark-native engine over libraries of digital publications."""
