"""Operators over telemetry tables: DataFrame in, DataFrame out."""
