"""Batch and streaming operators for seat-booking networks, on Spark DataFrames."""
