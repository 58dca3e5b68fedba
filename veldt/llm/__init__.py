"""Training-data operators: dedup, filtering, scanning, search, mixing and packing of documents.

Nothing else in the library imports this subpackage.
"""
