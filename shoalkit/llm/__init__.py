"""Training-data operators: near copies, contamination, quality, language, packing.

Nothing else in the library imports this subpackage.
"""
