"""A Spark-native maintenance and analytics engine for open tables."""
