"""Spark-native analytics for price time series: bars, features, as-of joins, targets, evaluation."""
