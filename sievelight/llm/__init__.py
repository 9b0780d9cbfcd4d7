"""Operators for building training corpora.

Nothing else in the library imports this package.  Every operator is a function
from DataFrames to a DataFrame; ``queries`` applies each of them to the driver's
tables with production parameters.
"""
