"""Small helpers for Column functions."""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def named(**fields: Column) -> Column:
    """A struct whose field names survive wherever the expression is moved."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def remembered(f):
    """``f`` (of hashable arguments), whose Columns are built once in an application: they name no DataFrame, and building a large one takes thousands of calls to the JVM."""
    known: dict = {}

    @wraps(f)
    def call(*args):
        session = SparkSession.getActiveSession()
        key = (session and session.sparkContext.applicationId, *args)
        if key not in known:
            known[key] = f(*args)
        return known[key]

    return call
