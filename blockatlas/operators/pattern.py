"""Listing patterns with ``*`` and ``?``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Characters that no pattern may have.
FORBIDDEN = '\\/:<>|"'


def to_regex(pattern: str) -> str:
    """An anchored, case-insensitive regular expression. Raises ValueError for a pattern that cannot match.

    Without ``?``, an extension of exactly three characters also stands for longer ones that begin so.
    """
    if not pattern or any(c in FORBIDDEN for c in pattern):
        raise ValueError(f"not a listing pattern: {pattern!r}")
    body = "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern)
    extension = re.search(r"\.([^.]*)$", pattern)
    if "?" not in pattern and extension and len(extension[1]) == 3:
        body += "[^.]*"
    return f"(?is)^{body}$"


def matches(name: Column, pattern: str) -> Column:
    if pattern == "*":
        return F.lit(True)
    try:
        return name.rlike(to_regex(pattern))
    except ValueError:
        return F.lit(False)


def find_files(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows whose name is the pattern (then only those), or else matches it."""
    exact = df.filter(F.lower(name) == pattern.lower())
    return exact if not exact.isEmpty() else df.filter(matches(F.col(name), pattern))
