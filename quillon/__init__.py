"""Quillon: Spark-first analytics for causal, bar-based time series."""
