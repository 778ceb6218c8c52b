"""Training-data operators: mixing, near-duplicates, scans, extraction, scoring, packing.

Nothing outside this subpackage imports it.
"""
