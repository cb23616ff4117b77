"""Operators for preparing training text: scoring, formatting, scanning, deduplication and tokenizing.

Nothing outside this subpackage imports it.
"""
