"""Training-data operators: fingerprints, near-duplicates, packing, quality, mixing and archives.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
