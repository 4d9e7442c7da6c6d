"""Spark-native payment-screening analytics: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
