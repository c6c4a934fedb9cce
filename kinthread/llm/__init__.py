"""Operators for preparing training data: search, language, URL rules, mixing,
secrets, token files, toxicity, byte-level BPE, quality rules, near duplicates.

Nothing outside this subpackage imports it.
"""
