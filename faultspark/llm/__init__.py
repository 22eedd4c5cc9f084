"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; ``queries`` here lists
its queries for the entry module.
"""
