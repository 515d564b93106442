"""Snapshot analytics on Spark: versioned file collections as DataFrames."""
