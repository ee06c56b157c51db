"""Value comparison rules and SQL literals, chosen from the static type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from tidemark.functions.columns import col

_TIMES = (T.TimestampType, T.TimestampNTZType)


def value_changed(
    a: Column, b: Column, a_type: T.DataType, b_type: T.DataType, tolerance_ms: float = 1
) -> Column:
    """True when two cells differ; never null.

    Timestamps differ beyond the tolerance, other equal types compare by
    value (null equals null, NaN equals NaN) and unequal types by their text.
    """
    if isinstance(a_type, _TIMES) and isinstance(b_type, _TIMES):
        if isinstance(a_type, T.TimestampNTZType) and isinstance(b_type, T.TimestampNTZType):
            apart = F.abs(a - b) > F.expr(f"INTERVAL '{tolerance_ms / 1000:.6f}' SECOND")
        else:
            micros = [F.unix_micros(c.cast("timestamp")) for c in (a, b)]
            apart = F.abs(micros[0] - micros[1]) > F.lit(int(tolerance_ms * 1000))
        return F.when(a.isNull() | b.isNull(), ~a.eqNullSafe(b)).otherwise(apart)
    if a_type != b_type and not (_texts(a_type) and _texts(b_type)):
        if isinstance(a_type, T.ArrayType) and isinstance(b_type, T.ArrayType):
            a, b = a.cast("array<string>"), b.cast("array<string>")
        else:
            a, b = a.cast("string"), b.cast("string")
    elif isinstance(a_type, T.MapType):
        a, b = (F.sort_array(F.map_entries(c)) for c in (a, b))
    elif isinstance(a_type, T.VariantType):
        a, b = F.to_json(a), F.to_json(b)
    return ~a.eqNullSafe(b)


def _texts(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def changed_columns(flags: Sequence[tuple[str, Column]]) -> Column:
    """Names whose flag is true, in the given order."""
    if not flags:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags]))


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_literal(value: Column, dtype: T.DataType) -> Column:
    """Literal that a PostgreSQL statement takes for this value."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(value, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif isinstance(dtype, (*_TIMES, T.DateType)):
        text = quoted(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSS"))
    elif isinstance(dtype, T.NumericType):
        text = value.cast("string")
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda x: F.coalesce(x.cast("string"), F.lit("")))
        text = F.concat(F.lit("'{"), F.array_join(items, ","), F.lit("}'"))
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit("'\\x"), F.lower(F.hex(value)), F.lit("'"))
    elif isinstance(dtype, (T.StructType, T.MapType, T.VariantType)):
        text = F.concat(quoted(F.to_json(value)), F.lit("::jsonb"))
    else:
        text = quoted(value.cast("string"))
    return F.when(value.isNull(), F.lit("NULL")).otherwise(text)


def sql_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def key_predicate(keys: Sequence[str], schema: T.StructType, value=col) -> Column:
    """``"k1" = 1 AND "k2" IS NULL`` for the key values of a row."""
    parts = []
    for k in keys:
        v = value(k)
        parts.append(
            F.when(v.isNull(), F.lit(f"{sql_name(k)} IS NULL")).otherwise(
                F.concat(F.lit(f"{sql_name(k)} = "), sql_literal(v, schema[k].dataType))
            )
        )
    return F.concat_ws(" AND ", *parts)
