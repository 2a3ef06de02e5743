"""Spark-native text-audit analytics: every operator is a DataFrame in, DataFrame out function."""
