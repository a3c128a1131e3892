"""Training-data operators: tokenisation, dedup, scoring, mixing, search.

Nothing else in the library imports this subpackage.
"""
