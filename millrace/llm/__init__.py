"""Training-data operators: tokenising, archives, filters, search, packing and deduplication.

Nothing else in the library imports this subpackage.
"""
