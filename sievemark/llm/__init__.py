"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each operator is a
function from DataFrames to a DataFrame; ``queries`` lists the registered ones.
"""
