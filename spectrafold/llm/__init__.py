"""Training-data operators: mixing, deduplication, tokenisation, scoring, search and scanning.

Nothing else in the library imports this subpackage.
"""
