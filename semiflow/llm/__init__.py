"""Operators of a training-data pipeline, written for Spark.

Nothing else in the library imports this subpackage.
"""
