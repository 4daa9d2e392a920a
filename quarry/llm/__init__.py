"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage.  Every module holds one
operator with a general interface; ``queries`` derives the registered digests.
"""
