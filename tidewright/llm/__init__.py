"""Operators for preparing text corpora: mixing, deduplication, filtering, sharding and encoding.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
