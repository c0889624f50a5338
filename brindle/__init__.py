"""brindle: a Spark-native engine for retrieval over, and analysis of, large text collections."""
