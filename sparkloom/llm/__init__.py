"""Operators of a training-data pipeline. Nothing outside this package imports it.

Every operator is a function of DataFrames with column names as parameters; the
thin queries in ``queries.py`` bind them to the driver's tables.
"""
