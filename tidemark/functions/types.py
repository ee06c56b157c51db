"""Column type names of a relational catalog."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Type aliases taken as equal, and those spelled out for display.
ALIASES = {
    "varchar": "character varying",
    "int4": "integer",
    "int": "integer",
    "int8": "bigint",
    "bool": "boolean",
    "timestamp": "timestamp without time zone",
    "numeric": "numeric",
    "decimal": "numeric",
}
DISPLAY_ALIASES = {
    "varchar": "character varying",
    "int4": "integer",
    "int8": "bigint",
    "bool": "boolean",
    "timestamp": "timestamp without time zone",
}


def _mapped(text: Column, aliases: dict[str, str], other: Column) -> Column:
    pairs = [F.lit(x) for item in aliases.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), other)


def normalize_type(name: Column) -> Column:
    """Lower-case canonical name; null and empty give an empty text."""
    text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return _mapped(text, ALIASES, text)


def display_type(name: Column) -> Column:
    """Canonical name where an alias exists, else the name as written."""
    return _mapped(F.lower(F.trim(F.coalesce(name, F.lit("")))), DISPLAY_ALIASES, F.coalesce(name, F.lit("")))


def type_string(name: Column, char_len: Column, precision: Column, scale: Column) -> Column:
    """``type(length)`` or ``numeric(p[,s])``."""
    base = display_type(name)
    digits = F.concat_ws(",", precision.cast("string"), scale.cast("string"))
    is_numeric = normalize_type(name) == "numeric"
    return (
        F.when(char_len.isNotNull(), F.concat(base, F.lit("("), char_len.cast("string"), F.lit(")")))
        .when(precision.isNotNull() & is_numeric, F.concat(base, F.lit("("), digits, F.lit(")")))
        .otherwise(base)
    )


def catalog_type(dtype: T.DataType) -> tuple[str, int | None, int | None, int | None]:
    """(type name, length, precision, scale) of a Spark type."""
    if isinstance(dtype, (T.VarcharType, T.CharType)):
        return ("character varying" if isinstance(dtype, T.VarcharType) else "character", dtype.length, None, None)
    if isinstance(dtype, T.DecimalType):
        return "numeric", None, dtype.precision, dtype.scale
    names = {
        T.StringType: "text", T.ByteType: "smallint", T.ShortType: "smallint", T.IntegerType: "integer",
        T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "double precision",
        T.BooleanType: "boolean", T.DateType: "date", T.BinaryType: "bytea",
        T.TimestampType: "timestamp with time zone", T.TimestampNTZType: "timestamp without time zone",
        T.VariantType: "jsonb", T.MapType: "jsonb", T.StructType: "jsonb",
    }
    if isinstance(dtype, T.ArrayType):
        return catalog_type(dtype.elementType)[0] + "[]", None, None, None
    return names.get(type(dtype), dtype.simpleString()), None, None, None
