"""A Spark-native engine for typed property graphs with text and vector indexes."""
