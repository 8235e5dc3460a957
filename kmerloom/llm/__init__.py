"""Training-data operators: dedup, scans, similarity joins, packing, privacy, scoring, mixing.

Nothing else in the library imports this subpackage; delete the folder and the rest still works.
"""
