"""Operators for training-data pipelines: one module per operator.

Nothing outside this package imports it; ``queries`` holds the registered
queries and their SQL.
"""
