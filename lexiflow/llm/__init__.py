"""Training-data operators: dedup, packing, quality, sharding, mixing, token files.

Nothing outside this subpackage imports it.
"""
