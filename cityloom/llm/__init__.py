"""Training-corpus operators: extraction, tokenisation, near-dedup, filtering and export.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
