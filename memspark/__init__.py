"""A Spark-native engine for long-term memory queries."""
