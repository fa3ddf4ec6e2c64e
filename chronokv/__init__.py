"""Versioned, ordered key-value change logs as DataFrames."""
