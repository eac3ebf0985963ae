"""Training-data operators: packing, deduplication, formatting, extraction, mixing, language and quality.

Nothing outside this subpackage imports it.
"""
