"""Operators for preparing large text corpora: scans, filters, deduplication, search and tokenization.

Nothing outside this subpackage imports it.
"""
