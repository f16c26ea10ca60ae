"""Training-data operators: packing, scoring, search, deduplication, encoding,
decontamination, language ID, sharding and PII detection.

Nothing else in the library imports this subpackage.
"""
