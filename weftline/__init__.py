"""A Spark-native engine for federated search, link intelligence and text retrieval."""
