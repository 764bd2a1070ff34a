"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface and a thin ``query`` that applies it to its
whole intended table.
"""
