"""Operators for preparing large training corpora.

Every module holds one operator with a general DataFrame interface; the thin
``opN_*`` queries that fix columns and parameters are in :mod:`queries`.
"""
