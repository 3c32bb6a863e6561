"""jobscope: diagnose distributed data jobs from their telemetry, on Spark.

Every operator is a function from DataFrames to a DataFrame.  The canonical input tables are
described in :mod:`jobscope.schemas`, the thresholds in :mod:`jobscope.settings`.
"""
