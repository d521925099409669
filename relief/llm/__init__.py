"""Operators of a training-data pipeline, one module each, as Spark DataFrame functions.

Nothing else in the library imports this subpackage.
"""
