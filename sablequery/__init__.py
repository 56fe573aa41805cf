"""A Spark-native engine for governed aggregate queries, document retrieval, text policy and log analytics."""
