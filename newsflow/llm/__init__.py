"""Operators for large text corpora used to train language models.

Nothing else in the library imports this folder.  ``queries`` registers one query per operator.
"""
