"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each operator has its own module
with a general interface; ``queries`` holds the thin registered queries.
"""
