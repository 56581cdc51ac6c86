"""Operators of a training-data pipeline.

Nothing else in the library imports this package.  Every operator takes and
returns DataFrames; :mod:`tidemark.llm.queries` applies each to its whole table.
"""
