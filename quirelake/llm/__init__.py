"""Operators that prepare a document corpus for training language models.

Nothing else in the package imports this folder.
"""
