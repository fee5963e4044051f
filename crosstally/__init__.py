"""Spark-native reconciliation, register, evaluation, catalogue and retrieval operators.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns);
nothing in the package collects data to the driver unless the result is bounded by
a parameter and the docstring says so.
"""
