"""Keyword scan over the text columns of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.columns import col, json_image
from tidemark.functions.text import clean_keywords, keywords_found, occurrences
from tidemark.operators.keys import union_all
from tidemark.operators.ranking import first_per_class

# Fixed value: keywords a scan looks for unless others are given.
DEFAULT_KEYWORDS = ("test", "dev", "tmp", "123")


def text_columns(df: DataFrame) -> list[str]:
    """Columns that hold text."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def _key(df: DataFrame, keys: Sequence[str]) -> Column:
    return json_image(list(keys) or df.columns)


def scan_table(
    table: str,
    df: DataFrame,
    keys: Sequence[str],
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    match: str = "substring",
) -> DataFrame:
    """Hits of one table: one row per (row, text column, keyword found).

    A text is looked through once for all keywords; rows without a hit end
    there. Rows of a table without key are named by their whole image and
    marked ``no_key``.
    """
    words = clean_keywords(keywords)
    named = F.array(*map(F.lit, words)).cast("array<string>")

    def hits(i: int, c: str) -> Column:
        return F.transform(
            keywords_found(col(c), keywords, match),
            lambda j: F.struct(
                F.lit(i).alias("column_pos"), F.lit(c).alias("column_name"), j.alias("keyword_pos"),
                F.get(named, j).alias("keyword"), col(c).alias("content"),
            ),
        )

    found = [hits(i, c) for i, c in enumerate(text_columns(df))]
    if not found:
        found = [F.array().cast("array<struct<column_pos:int,column_name:string,keyword_pos:int,keyword:string,content:string>>")]
    return df.select(_key(df, keys).alias("key"), F.inline(F.concat(*found))).select(
        F.lit(table).alias("table_name"), F.lit(not keys).alias("no_key"), "key",
        "column_pos", "column_name", "keyword_pos", "keyword", "content",
    )


def table_records(
    table: str,
    df: DataFrame,
    keys: Sequence[str],
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    match: str = "substring",
) -> DataFrame:
    """Rows of one table that hold a keyword, as `dedupe_hits` gives them.
    Each is put together where it is read: no text is copied for a second hit
    and nothing is shuffled. The keys must be unique."""
    words, names = clean_keywords(keywords), text_columns(df)
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    place = lambda i: lambda j: F.struct(j.alias("k"), F.lit(i).alias("c"))
    hits = F.array().cast("array<struct<k:int,c:int>>")
    if names:
        hits = F.concat(*[F.transform(keywords_found(col(c), keywords, match), place(i)) for i, c in enumerate(names)])
    # Lists of one make the hits a variable, so that they are found once.
    rows = F.filter(
        F.array(F.struct(F.array_sort(hits).alias("h"), F.array(*map(col, names)).cast("array<string>").alias("t"))),
        lambda r: F.size(r["h"]) > 0,
    )
    said = lambda values, part: lambda h: F.get(texts(values), h[part])
    each = lambda r, values, part: F.array_sort(F.array_distinct(F.transform(r["h"], said(values, part))))
    record = lambda r: F.struct(
        said(words, "k")(F.get(r["h"], F.lit(0))).alias("keyword"),
        F.get(r["t"], F.get(r["h"], F.lit(0))["c"]).alias("content"),
        each(r, names, "c").alias("columns"), each(r, words, "k").alias("keywords"),
    )
    return df.select(_key(df, keys).alias("key"), F.inline(F.transform(rows, record))).select(
        F.lit(table).alias("table_name"), F.lit(not keys).alias("no_key"), "key", "keyword", "content", "columns", "keywords",
    )


def data_scope(tables: Mapping[str, DataFrame], schemas: Mapping[str, str], scopes: DataFrame) -> dict[str, DataFrame]:
    """Tables whose schema is selected for data by ``scopes`` (schema,
    include_data), any letter case. At most one name per table is asked of
    the scopes; tables that are not selected are never read."""
    places = sorted({schemas[t].lower() for t in tables if t in schemas})
    schema = F.lower("schema")
    chosen = {r[0] for r in scopes.where(F.col("include_data") & schema.isin(places)).select(schema).distinct().collect()}
    return {t: df for t, df in tables.items() if t in schemas and schemas[t].lower() in chosen}


def _scoped(
    tables: Mapping[str, DataFrame], schemas: Mapping[str, str] | None, scopes: DataFrame | None
) -> dict[str, DataFrame]:
    """The tables to scan, or where none is selected one of them without rows."""
    if scopes is None:
        return dict(tables)
    chosen = data_scope(tables, schemas or {}, scopes)
    return chosen or {t: df.where("false") for t, df in sorted(tables.items())[:1]}


def scan_records(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    match: str = "substring",
    cap: int | None = None,
    schemas: Mapping[str, str] | None = None,
    scopes: DataFrame | None = None,
) -> DataFrame:
    """Hits of all tables. ``cap`` keeps the first hits in key order per
    (table, column, keyword); by default all are kept. ``scopes`` selects
    tables by their schema in ``schemas``, see `data_scope`."""
    chosen = _scoped(tables, schemas, scopes)
    hits = union_all([scan_table(t, df, keys.get(t, ()), keywords, match) for t, df in sorted(chosen.items())])
    if cap is None:
        return hits
    return first_per_class(hits, ["table_name", "column_name", "keyword"], ["key"], cap)


def found_records(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    match: str = "substring",
    schemas: Mapping[str, str] | None = None,
    scopes: DataFrame | None = None,
) -> DataFrame:
    """`table_records` of all tables, or of those that ``scopes`` selects."""
    chosen = _scoped(tables, schemas, scopes)
    return union_all([table_records(t, df, keys.get(t, ()), keywords, match) for t, df in sorted(chosen.items())])


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """One row per record: the first keyword by list position, and all its
    columns and keywords in alphabetical order. Equal rows of a table without
    key are as many records, each of which has every hit once. For hits that
    were cut or gathered; `found_records` gives the records of whole tables
    without a shuffle."""
    first = F.struct("keyword_pos", "column_pos")
    same = F.when(F.col("no_key"), (F.col("_hits") / F.size("_kinds")).cast("int")).otherwise(1)
    return hits.groupBy("table_name", "no_key", "key").agg(
        F.min_by("keyword", first).alias("keyword"),
        F.min_by("content", first).alias("content"),
        F.array_sort(F.collect_set("column_name")).alias("columns"),
        F.array_sort(F.collect_set("keyword")).alias("keywords"),
        F.count("*").alias("_hits"),
        F.collect_set(first).alias("_kinds"),
    ).withColumn("_copy", F.explode(F.sequence(F.lit(1), same))).drop("_hits", "_kinds", "_copy")


def hits_by_table(records: DataFrame, rollup: DataFrame | None = None) -> DataFrame:
    """Records per table and whether any has child rows, sorted by table.
    ``rollup`` is a `cascade_rollup` of the records."""
    cascade = F.lit(False)
    if rollup is not None:
        reached = rollup.select(F.col("root_table").alias("table_name"), F.col("root_key").alias("key"), F.lit(True).alias("_hit"))
        records = records.join(reached, ["table_name", "key"], "left_outer")
        cascade = F.coalesce(F.bool_or("_hit"), F.lit(False))
    return (
        records.groupBy("table_name").agg(F.count("*").alias("n_records"), cascade.alias("has_cascade"))
        .orderBy("table_name")
    )


def keyword_occurrences(df: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """The frame with one column ``n_<keyword>`` per keyword."""
    return df.select("*", *[occurrences(col(text), k).cast("bigint").alias("n_" + k) for k in clean_keywords(keywords)])
