"""Spark-native analytics of dense, gridded, multi-channel time series."""
