"""A Spark-native engine for annotated, tokenised text collections."""
