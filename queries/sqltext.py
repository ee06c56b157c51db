"""SQL a row diff must agree with, written as a plain full join."""

from __future__ import annotations

from collections.abc import Sequence

from queries.frames import with_frames

ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
LINEITEM = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
STAMPS = {"o_orderdate", "l_shipdate"}


def changed(c: str) -> str:
    if c in STAMPS:
        return (
            f"(((s.{c} IS NULL) <> (t.{c} IS NULL)) OR coalesce(abs(epoch_us(s.{c}) - epoch_us(t.{c})) > 1000, false))"
        )
    return f"(s.{c} IS DISTINCT FROM t.{c})"


def diff_cte(
    name: str, src: str, tgt: str, keys: Sequence[str], columns: Sequence[str],
    ignore: Sequence[str] = (), where: str = "true", occurrence: bool = False,
) -> str:
    """``name AS (...)`` with op, keys, occurrence, s_*, t_* and changed."""
    compared = [c for c in columns if c not in keys and c not in ignore]
    number = "1"
    if occurrence:
        order = ", ".join(f"{c} ASC NULLS FIRST" for c in compared)
        number = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})"
    side = lambda frame: f"(SELECT *, true AS here, {number} AS occ FROM {frame} WHERE {where})"
    on = " AND ".join([f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys] + ["s.occ = t.occ"])
    names = ", ".join(f"CASE WHEN {changed(c)} THEN '{c}' END" for c in compared) or "NULL"
    any_changed = " OR ".join(changed(c) for c in compared) or "false"
    images = ", ".join(f"s.{c} AS s_{c}, t.{c} AS t_{c}" for c in columns)
    key_columns = ", ".join(f"CASE WHEN s.here THEN s.{k} ELSE t.{k} END AS {k}" for k in keys)
    return f"""{name} AS (
SELECT CASE WHEN t.here IS NULL THEN 'I' WHEN s.here IS NULL THEN 'D' WHEN {any_changed} THEN 'U' ELSE 'S' END AS op,
       {key_columns}, coalesce(s.occ, t.occ) AS occurrence, {images},
       CASE WHEN s.here AND t.here THEN concat_ws(',', {names}) ELSE '' END AS changed
FROM {side(src)} s FULL OUTER JOIN {side(tgt)} t ON {on})"""


def orders_diff(ignore: Sequence[str] = (), where: str = "true") -> str:
    return with_frames("old_orders") + ",\n" + diff_cte("d", "orders", "old_orders", ["o_orderkey"], ORDERS, ignore, where)


def counts(frame: str = "d") -> str:
    n = lambda cond: f"CAST(count(*) FILTER ({cond}) AS BIGINT)"
    return (
        f"{n('op = ' + chr(39) + 'I' + chr(39))} AS inserted, {n('op = ' + chr(39) + 'D' + chr(39))} AS deleted, "
        f"{n('op = ' + chr(39) + 'U' + chr(39))} AS updated, {n('op <> ' + chr(39) + 'D' + chr(39))} AS source_rows, "
        f"{n('op <> ' + chr(39) + 'I' + chr(39))} AS target_rows, count(*) FILTER (op <> 'S') > 0 AS has_differences"
    )


def summary(table: str, frame: str = "d") -> str:
    return (
        f"SELECT '{table}' AS table_name, {counts(frame)}, "
        f"CASE WHEN count(*) FILTER (op <> 'S') > 0 THEN 'Different' ELSE 'Synchronized' END AS status FROM {frame}"
    )


def literal(c: str, kind: str) -> str:
    """PostgreSQL literal of a column: text, number or stamp."""
    body = {
        "text": f"'''' || replace({c}, '''', '''''') || ''''",
        "number": f"CAST({c} AS VARCHAR)",
        "stamp": f"'''' || strftime({c}, '%Y-%m-%d %H:%M:%S.%g') || ''''",
    }[kind]
    return f"coalesce({body}, 'NULL')"


ORDERS_KINDS = {
    "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number",
    "o_orderdate": "stamp", "o_orderpriority": "text",
}
CUSTOMER_KINDS = {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"}


def dml(table: str, key: str, kinds: dict[str, str], upsert: bool = False) -> str:
    """Statement for a row of `diff_cte`."""
    names = ", ".join(f'"{c}"' for c in kinds)
    values = " || ', ' || ".join(literal("s_" + c, k) for c, k in kinds.items())
    insert = f"""'INSERT INTO public."{table}" ({names}) VALUES (' || {values} || ')'"""
    where = f"""' WHERE "{key}" = ' || CAST(t_{key} AS VARCHAR) || ';'"""
    if upsert:
        sets = ", ".join(f'"{c}" = EXCLUDED."{c}"' for c in kinds if c != key)
        insert = f"""{insert} || ' ON CONFLICT ("{key}") DO UPDATE SET {sets};'"""
        update = insert
    else:
        insert = f"{insert} || ';'"
        parts = ", ".join(
            f"""CASE WHEN list_contains(string_split(changed, ','), '{c}') THEN '"{c}" = ' || {literal('s_' + c, k)} END"""
            for c, k in kinds.items() if c != key
        )
        update = f"""'UPDATE public."{table}" SET ' || concat_ws(', ', {parts}) || {where}"""
    return f"""CASE op WHEN 'D' THEN 'DELETE FROM public."{table}"' || {where} WHEN 'I' THEN {insert} WHEN 'U' THEN {update} END"""
