"""Operators for preparing training text: deduplication, filtering, decontamination and tokens.

Nothing outside this subpackage imports it.
"""
