"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; Python runs inside Arrow-batched tasks only.
"""
