"""Spark-native expression analytics: every operator maps DataFrames to DataFrames."""
