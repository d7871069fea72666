"""Training-data operators (quality, extraction, dedup, PII, packing, mixing).

Nothing else in the library imports this subpackage; it may be deleted as a whole.
"""
