"""Operators for preparing training text: dedup, filtering, scoring, mixing, packing, output.

Nothing else in the library imports this subpackage.
"""
