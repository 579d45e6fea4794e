"""Operators for training-data pipelines, each built by one named method.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; the modules say how nulls, empty texts, ties, repeated
rows, empty tables and clashing column names are treated.
"""
