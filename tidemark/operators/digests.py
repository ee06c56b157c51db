"""What differs between two snapshots, found without moving row images.

A row's digest is 128 bits of two hashes over its compared cells, or 86 of them
where groups are numbers of keys. Digests are added up, those of the source
with plus and those of the target with minus, so rows that are on both sides
cancel out in any order and any number. The sums are combined before the
shuffle: what moves is a key, its number, or the number of a key range, and a
few integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.columns import JSON_OPTIONS, any_of, col

# Key ranges of a comparison; a hundred bytes each, whatever the tables hold.
RANGES = 4096

# A hash of 64 bits in pieces that 2^41 rows of a group may add up.
_PIECES = ((0, 22), (22, 21), (43, 21))
# Bits taken of each hash where groups are keys: two sums that shuffle densely.
# A group of more than 2^20 rows may be too much for a sum, which is null then
# and counts as different.
_WIDE = 43

_PLAIN = (T.NumericType, T.StringType, T.CharType, T.VarcharType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def comparable_keys(src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> bool:
    """May keys of both sides be grouped and hashed together?"""
    return all(src.schema[k].dataType == tgt.schema[k].dataType for k in keys)


def _cell(df: DataFrame, other: DataFrame, name: str) -> Column:
    """A cell so that equal digests mean equal cells; those that differ may still be equal."""
    mine = df.schema[name].dataType
    if isinstance(mine, T.VariantType):
        value = F.to_json(col(name))
    elif isinstance(mine, _PLAIN):
        value = col(name)
    else:
        value = F.to_json(F.struct(col(name).alias("v")), JSON_OPTIONS)
    return value if other.schema[name].dataType == mine else value.cast("string")


def _pieces(hashes: Sequence[Column], small_groups: bool) -> list[Column]:
    """What is added up of two hashes: all bits, or for small groups 86 of them in two numbers."""
    pieces = ((0, _WIDE),) if small_groups else _PIECES
    return [F.shiftrightunsigned(h, start).bitwiseAND(F.lit((1 << width) - 1)) for h in hashes for start, width in pieces]


def _signed(
    df: DataFrame, other: DataFrame, group: Sequence[Column], names: Sequence[str], is_source: bool, small_groups: bool
) -> DataFrame:
    # Hashes pass over nulls, so where they are is hashed as well.
    cells = [c for n in names for c in (_cell(df, other, n), col(n).isNull())]
    sign = 1 if is_source else -1
    pieces = _pieces([F.xxhash64(F.lit(i), *cells) for i in (1, 2)], small_groups)
    rows = [F.lit(int(is_source)).alias("_s"), F.lit(int(not is_source)).alias("_t")]
    return df.select(*group, *rows, *[(p * F.lit(sign)).alias(f"_d{i}") for i, p in enumerate(pieces)])


def _unequal(
    src: DataFrame, tgt: DataFrame, group: Sequence[Column], names: Sequence[str], groups: Sequence[str], small_groups: bool = False
) -> DataFrame:
    both = _signed(src, tgt, group, names, True, small_groups).unionAll(_signed(tgt, src, group, names, False, small_groups))
    added = F.try_sum if small_groups else F.sum
    digests = [c for c in both.columns if c.startswith("_d")]
    sums = both.groupBy(*[col(g) for g in groups]).agg(
        F.sum("_s").alias("source_rows"), F.sum("_t").alias("target_rows"), *[added(d).alias(d) for d in digests]
    )
    differ = any_of([F.col("source_rows") != F.col("target_rows"), *[~F.col(d).eqNullSafe(F.lit(0)) for d in digests]])
    return sums.where(differ).drop(*digests)


def differing_keys(src: DataFrame, tgt: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """(keys, source_rows, target_rows) of the keys whose rows are not the same
    on both sides, repeats counted. Keys left out have equal rows; a key that
    is here may have rows that only differ in a way that does not count, such
    as a timestamp within its tolerance."""
    return _unequal(src, tgt, [col(k) for k in keys], compared, keys)


def may_number(df: DataFrame, keys: Sequence[str]) -> bool:
    """Have equal keys one number? Strings that are equal under a collation may not."""
    plain = lambda t: isinstance(t, _PLAIN) and (not isinstance(t, T.StringType) or t.simpleString() in ("string", "string collate UTF8_BINARY"))
    return all(plain(df.schema[k].dataType) for k in keys)


def key_number(keys: Sequence[str]) -> Column:
    """Number of a key, equal for equal keys; seldom also for others."""
    return F.xxhash64(*[c for k in keys for c in (col(k), col(k).isNull())])


def differing_numbers(src: DataFrame, tgt: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """(number, source_rows, target_rows): `differing_keys` by the numbers of
    the keys, so that what moves is one number, however wide the key. Keys of
    one number are here together if one of them differs."""
    return _unequal(src, tgt, [key_number(keys).alias("number")], [*keys, *compared], ["number"], small_groups=True)


def key_range(keys: Sequence[str], ranges: int = RANGES) -> Column:
    """Number of the range a key belongs to."""
    return F.pmod(key_number(keys), F.lit(ranges)).cast("int")


def differing_ranges(
    src: DataFrame, tgt: DataFrame, keys: Sequence[str], compared: Sequence[str], ranges: int = RANGES
) -> DataFrame:
    """(range, source_rows, target_rows) of the key ranges that hold other keys
    or rows on the two sides. At most ``ranges`` rows leave each task."""
    return _unequal(src, tgt, [key_range(keys, ranges).alias("range")], [*keys, *compared], ["range"])
