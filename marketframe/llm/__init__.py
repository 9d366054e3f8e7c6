"""Operators for training-data pipelines.  Nothing else in the library imports this package.

``QUERIES`` maps a query's name to a function of (spark, folder); ``ORACLES`` holds the SQL of those that
DuckDB can express.
"""
