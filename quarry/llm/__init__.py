"""Operators of a training-data pipeline: one module per operator, the
registered queries in ``queries.py``.  Nothing else in the library imports
this subpackage."""
