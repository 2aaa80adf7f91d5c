"""A Spark-native engine for research on panels of market-style data, and for corpus preparation."""
