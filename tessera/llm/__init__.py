"""Operators for building language-model training corpora.

Each module holds one operator with a general interface; ``queries`` holds the
registered queries.  Nothing else in the package imports this subpackage.
"""
