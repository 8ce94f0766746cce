"""Operators for preparing training text at scale.

Each module holds one operator with a general DataFrame-in / DataFrame-out
interface; ``queries`` registers the thin per-table queries and ``sql`` their
DuckDB counterparts.  Nothing outside this subpackage imports it except the
guarded hook in ``__spark_entry__`` and ``corpus_pipeline``.
"""
