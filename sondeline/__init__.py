"""Spark-first telemetry analytics: every operator takes DataFrames and returns a lazy DataFrame."""
