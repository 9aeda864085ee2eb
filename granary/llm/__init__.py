"""Training-data operators: formatting, deduplication, filtering, packing and token output.

Nothing outside this subpackage imports it.
"""
