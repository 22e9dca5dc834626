"""Operators a large training-data pipeline needs: tokenising, deduplication, packing, archives.

Nothing else in the library imports this subpackage.
"""
