"""marginalia: a Spark-native corpus processing and retrieval library."""
