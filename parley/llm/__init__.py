"""Training-data operators: deduplication, quality, tokenisation, scoring, mixing and search.

Nothing outside this package imports it.
"""
