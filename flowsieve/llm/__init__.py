"""Operators for building large training corpora (deduplication, quality, mixing, tokenising).

Nothing outside this folder imports it; ``queries.py`` lists the registered queries."""
