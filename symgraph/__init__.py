"""A Spark-native engine for code intelligence: symbols, relationships, search, impact, evaluation."""
