"""Training-data operators: deduplication, scans, classifiers, search and mixing.

Nothing outside this subpackage imports it.
"""
