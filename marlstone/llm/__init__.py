"""Training-data operators: packing, mixing, scanning, search, deduplication, scoring.

Nothing outside this subpackage imports it.
"""
