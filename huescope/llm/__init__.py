"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes
and returns DataFrames, selects only the columns it needs (extra columns
with any name are harmless) and documents what it does with nulls, empty
tables, repeated rows and ties.
"""
