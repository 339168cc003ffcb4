"""Operators of a training-data pipeline over text and embedding tables.

Nothing outside this subpackage imports it.
"""
