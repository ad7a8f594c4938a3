"""Spark-first analytics for multi-sensor vibration and time series."""
