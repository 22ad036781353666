"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. Each operator has a general
interface over any DataFrame; `queries.py` applies them to whole tables.
"""
