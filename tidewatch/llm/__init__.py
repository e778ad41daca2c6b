"""Operators for training-data preparation on Spark."""
