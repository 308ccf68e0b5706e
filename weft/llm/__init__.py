"""Training-data operators: language id, exact and approximate search, mixing,
token files, LM scoring, near-duplicate and substring removal, quality, BPE.

Nothing else in the library imports this subpackage.
"""
