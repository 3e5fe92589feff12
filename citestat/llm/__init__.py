"""Operators for training-data pipelines over tables of texts.

Nothing else in the library imports this package.
"""
