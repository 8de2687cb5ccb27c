"""Training-data operators: dedup, mixing, decontamination, scans, formats and archives.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to DataFrames; :mod:`tidemark.llm.queries` binds them to the tables.
"""
