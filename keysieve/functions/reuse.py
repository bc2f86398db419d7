"""Build large column expressions once per application."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def built_once(build: Callable) -> Callable:
    """Keep what ``build`` returns for its arguments while the application lives.

    Columns are unresolved expressions, so the same one serves every DataFrame;
    the catalogue's signatures alone take some thousand calls to spell out.
    """
    kept: dict = {}

    @wraps(build)
    def reuse(*args):
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, args)
        if key not in kept:
            kept.clear() if any(k[0] != key[0] for k in kept) else None
            kept[key] = build(*args)
        return kept[key]

    return reuse

