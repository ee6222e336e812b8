"""Training-data operators: dedup, token files, packing, fingerprints, language, quality, shards.

Nothing outside this subpackage imports it.
"""
