"""Training-data operators: packing, filtering, deduplication, mixing, scoring.

Nothing else in the library imports this subpackage.
"""
