"""Operators for building training corpora.

Every module holds one operator with its own general interface; `queries`
applies each to the tables of a folder. Nothing else in the library imports
this package.
"""
