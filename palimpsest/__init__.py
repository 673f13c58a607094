"""Grep-style analytics over versioned text, built from Spark DataFrames."""
