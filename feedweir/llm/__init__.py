"""Operators of a training-data pipeline: each module holds one operator, ``queries`` binds them to the sample tables."""
