"""Operators for preparing training text: packing, encoding, quality, scans, sharding, near copies and storage.

Nothing outside this folder imports it. Queries over the given tables are in ``queries``.
"""
