"""Training-data operators: dedup, classification, packing, formatting and file formats.

Nothing outside this subpackage imports it.
"""
