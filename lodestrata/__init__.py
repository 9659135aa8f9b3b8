"""Spark-native knowledge consolidation: DataFrame in, DataFrame out."""
