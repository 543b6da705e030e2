"""Functions over Arrow batches as column functions, made when first called, so that importing them needs no session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str) -> Callable:
    """A pandas function whose hints say how it is called, of a type named in DDL."""

    def add(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, returnType=kind)(*columns)

        return call

    return add
