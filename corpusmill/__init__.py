"""Spark-native text search, mining and relational analytics over DataFrames."""
