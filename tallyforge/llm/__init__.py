"""Training-data operators: quality rules and classifier, deduplication, tokens, packing, sharding, media.

Nothing else in the library imports this subpackage.
"""
