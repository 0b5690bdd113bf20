"""Operators for preparing training text: scoring, sharding, encoding, archiving, matching and filtering.

Nothing outside this subpackage imports it.
"""
