"""Leak-safe time-series features, rating replay and model evaluation on Spark."""
