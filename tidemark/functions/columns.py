"""Names, keys and small column helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def col(name: str, prefix: str = "") -> Column:
    """Column by its literal name, dots and quotes included."""
    return F.col("`" + (prefix + name).replace("`", "``") + "`")


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def null_safe(pairs: Iterable[tuple[str, str]]) -> Column:
    """Join condition in which null keys meet null keys."""
    return all_of(col(a).eqNullSafe(col(b)) for a, b in pairs)


def renamed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    """Only these columns, each with the prefix."""
    return df.select(*[col(n).alias(prefix + n) for n in names])


def lower_set(names: Iterable[str]) -> set[str]:
    return {n.lower() for n in names}


JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def json_image(names: Sequence[str], prefix: str = "") -> Column:
    """Columns as one JSON object; keeps nulls and microseconds, so that it
    can be read back and two different keys never share a text."""
    return F.to_json(F.struct(*[col(n, prefix).alias(n) for n in names]), JSON_OPTIONS)
