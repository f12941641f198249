"""Operators for preparing training text: filters, scores, near-duplicates, mixing and packing.

Every module holds one operator with its own interface; ``queries`` registers the thin
``opN_<name>`` queries over the given tables. Nothing outside this folder imports it.
"""
