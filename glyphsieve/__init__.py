"""A Spark-native text-lint and text-data engine."""
