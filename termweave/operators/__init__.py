"""Operators: functions from DataFrames to DataFrames that only build plans.

The two exceptions store an intermediate table first and say so:
:func:`termweave.operators.ordering.number_rows` and what is built on it.
"""
