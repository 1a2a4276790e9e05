"""Anomaly analytics over gap-sessionized sensor and event streams, as Spark DataFrames."""
