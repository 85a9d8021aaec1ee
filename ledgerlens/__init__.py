"""Cleaning, profiling and risk analysis of large tables of labelled transactions on Spark."""
