"""Training-data operators: packing, extraction, deduplication, scoring, filtering, counting.

Nothing else in the library imports this subpackage; ``registry`` lists its queries.
"""
