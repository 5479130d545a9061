"""Training-data operators: mixing, scoring, fingerprints, near copies, packing, archives, search, shards and scans.

Nothing else in the library imports this subpackage; the queries are in :mod:`senseloom.llm.queries`.
"""
