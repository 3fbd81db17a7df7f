"""Training-data operators. Nothing outside this subpackage imports it.

Each operator takes and returns DataFrames and names its columns through
arguments, so extra columns of the input (also ones with clashing names) never
matter; the thin queries in ``queries.py`` derive the contract's columns.
"""
