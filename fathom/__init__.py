"""A Spark-native document search and aggregation engine."""
