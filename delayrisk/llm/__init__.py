"""Operators for building training data from web-scale corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers one query per operator.
"""
