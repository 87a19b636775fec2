"""A Spark-native engine for document collections: parse, chunk, search, evaluate."""
