"""Training-data operators: mixing, deduplication, filtering, scoring and packing.

Nothing outside this folder imports it.
"""
