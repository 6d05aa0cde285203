"""Leak-free probabilistic forecasting and evaluation over point-in-time data, on Spark DataFrames."""
