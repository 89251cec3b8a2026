"""Operators for preparing training data: packing, deduplication, search, mixing, filters, classifiers, phrases, whitening and token counts.

Nothing outside this package imports it. ``tablesight.llm.queries`` applies every operator to its whole table.
"""
