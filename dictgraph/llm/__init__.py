"""Operators of a training-data pipeline over tables of documents.

Nothing outside this subpackage imports it. Every operator takes a DataFrame,
selects the columns it names as parameters (other columns, also ones whose
names clash with its results, are left out) and returns a DataFrame.
"""
