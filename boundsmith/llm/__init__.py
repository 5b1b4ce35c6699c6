"""Training-data operators: deduplication, filtering, tokenisation, packing.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames and leaves columns it does not know untouched.
"""
