"""Operators for large training-data pipelines: encoding, scans, near-duplicates, search and packing."""
