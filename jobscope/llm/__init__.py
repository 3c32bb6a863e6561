"""Operators for preparing language-model training data, each a function from DataFrames to a DataFrame.

Nothing else in the library imports this subpackage.  Executors must be able to import ``jobscope``.
"""
