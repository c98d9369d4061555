"""Operators for preparing training corpora at scale (one module each).

Nothing outside this subpackage imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
