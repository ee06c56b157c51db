"""Configuration drift: JSON and ENV files of any number of hosts.

Every file is one row; its tree is taken apart inside that row's task, so the
only shuffle is the one that brings the two versions of a file together. Trees
may have any depth the JSON reader takes. A file that cannot be read is left
out and named by `json_errors`; all others give their results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import col
from tidemark.functions.json_parts import difference_texts, leaf_texts
from tidemark.functions.secrets import clean_json, is_secret


def json_type(text: Column) -> Column:
    """object, array, string, boolean, null or number, from the JSON text."""
    first = F.substring(text, 1, 1)
    return (
        F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string")
        .when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    )


def _plain(v: Column, text: Column) -> Column:
    """Strings without quotes, everything else as JSON."""
    return F.when(F.substring(text, 1, 1) == '"', F.variant_get(v, "$", "string")).otherwise(text)


def _parsed(text: Column) -> Column:
    """The JSON value of a text, null where it cannot be read."""
    return F.try_parse_json(text)


def _readable(text: Column) -> Column:
    return text.isNull() | _parsed(text).isNotNull()


def _reason(text: Column) -> Column:
    """Why a text cannot be read, null where it can."""
    repeated = F.get_json_object(text, "$").isNotNull()
    return F.when(~_readable(text), F.when(repeated, "a name is repeated, or text follows the end").otherwise("no readable JSON"))


def json_errors(df: DataFrame, doc: str, content: str) -> DataFrame:
    """(doc, error) of the texts that cannot be read as JSON."""
    return df.select(col(doc).alias(doc), _reason(col(content)).alias("error")).where("error IS NOT NULL")


def _once(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """The columns next to ``keep``, computed once. A filter on them stays
    above the generator; below, Spark would read a text again for every mention."""
    return df.select(*keep, F.inline_outer(F.array(F.struct(*columns))))


def json_leaves(df: DataFrame, doc: str, content: str, into_arrays: bool = False) -> DataFrame:
    """(doc, path, type, value) of everything that is not a non-empty object;
    path is an array of names. ``into_arrays`` also takes lists apart, with
    the index as name. One pass over the file, whatever its depth. Files that
    cannot be read have no rows, see `json_errors`."""
    if doc == "path":
        raise ValueError("the document column must not be called path")
    # Not filters, which Spark would put in front of a `spread`. An outer
    # generator does not ask for its array twice.
    text = col(content)
    read = df.select(col(doc).alias("doc"), leaf_texts(text, _readable(text), into_arrays).alias("_leaves"))
    leaves = read.select("doc", F.inline_outer("_leaves")).where("path IS NOT NULL")
    leaves = leaves.withColumn("v", _parsed(F.col("text"))).withColumn("text", F.to_json("v"))
    found = _once(leaves, ["doc", "path"], json_type(F.col("text")).alias("type"), _plain(F.col("v"), F.col("text")).alias("value"))
    return found.withColumnRenamed("doc", doc)


def dotted(path: Column) -> Column:
    return F.array_join(path, ".")


def flatten_json(df: DataFrame, doc: str, content: str) -> DataFrame:
    """(doc, path, type, value) of the leaves, arrays whole."""
    return json_leaves(df, doc, content).withColumn("path", dotted(F.col("path")))


def _compared(parts: DataFrame, keep: list[str]) -> DataFrame:
    """Parts of two JSON texts (path_parts, old, new) by their meaning: kind
    of change, values and types. Those that mean the same have no change."""
    ends = parts.withColumn("o", _parsed(F.col("old"))).withColumn("n", _parsed(F.col("new")))
    ends = ends.withColumn("o_text", F.to_json("o")).withColumn("n_text", F.to_json("n"))
    o_text, n_text = F.col("o_text"), F.col("n_text")
    o_type, n_type = json_type(o_text), json_type(n_text)
    change = (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "removed")
        .when((o_type == "array") & (n_type == "array"), F.when(o_text != n_text, "array"))
        .when(o_text != n_text, "value")
    )
    return _once(
        ends, [*keep, "path_parts"], change.alias("change"),
        _plain(F.col("o"), o_text).alias("old_value"), _plain(F.col("n"), n_text).alias("new_value"),
        o_type.alias("old_type"), n_type.alias("new_type"),
    )


def json_diff(old: DataFrame, new: DataFrame, doc: str, content: str) -> DataFrame:
    """Differences between two versions of JSON texts, by document.

    added and removed report a subtree once, at its top; two objects are
    compared member by member, two arrays as a whole and in order (array),
    anything else by value. Documents found on one side only are not here,
    see `tree_diff`, nor are those of which a version cannot be read, see
    `json_errors`.
    """
    if doc == "path":
        raise ValueError("the document column must not be called path")
    pairs = old.select(doc, F.col(content).alias("_old")).join(new.select(doc, F.col(content).alias("_new")), doc)
    o, n = F.col("_old"), F.col("_new")
    parts = pairs.select(doc, difference_texts(o, n, _readable(o) & _readable(n)).alias("_parts"))
    parts = parts.select(doc, F.inline_outer("_parts").alias("path_parts", "old", "new")).where("path_parts IS NOT NULL")
    found = _compared(parts, [doc]).where("change IS NOT NULL")
    return found.select(doc, dotted(F.col("path_parts")).alias("path"), "change", "old_value", "new_value")


def redact_json(df: DataFrame, doc: str, content: str, deep: bool = False) -> DataFrame:
    """Leaves of JSON texts with blank secrets, lists taken apart.

    A string whose own name is secret is emptied. Objects and lists under a
    secret name are left as they are, or with ``deep`` emptied throughout.
    """
    leaves = json_leaves(df, doc, content, into_arrays=True)
    above = F.exists(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))), is_secret)
    own = F.coalesce(is_secret(F.element_at("path", -1)), F.lit(False)) & (F.size("path") > 0)
    secret = (own | above) if deep else (own & ~above)
    value = F.when((F.col("type") == "string") & secret, F.lit("")).otherwise(F.col("value"))
    return leaves.select(doc, dotted(F.col("path")).alias("path"), "type", value.alias("value"))


def _env_key(line: Column) -> Column:
    """Name set by a line, null for blanks, comments and lines without one."""
    name = F.regexp_extract(F.trim(line), "^([^#=][^=]*)=", 1)
    return F.when(name != "", F.trim(name))


def _env_value(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(line), "^[^=]*=", ""))


def parse_env(lines: DataFrame, doc: str, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(doc, line_no, key, value) of the lines that set a variable."""
    return lines.select(
        doc, F.col(line_no).alias("line_no"), _env_key(col(line)).alias("key"), _env_value(col(line)).alias("value")
    ).where("key IS NOT NULL")


def env_diff(old: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """Variables added, removed and changed between two `parse_env` frames.
    The last setting of a variable counts. One aggregation over both sides."""
    side = lambda df, s: df.select(doc, F.lit(s).alias("side"), "line_no", "key", "value")
    return _env_changes(side(old, "o").unionAll(side(new, "n")), doc)


def _env_changes(settings: DataFrame, doc: str) -> DataFrame:
    """Changes between the settings of side o and those of side n."""
    last = lambda s: F.max(F.when(F.col("side") == s, F.struct("line_no", "value")))
    both = settings.groupBy(doc, "key").agg(last("o").alias("_o"), last("n").alias("_n"))
    change = (
        F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
        .when(F.col("_o.value") != F.col("_n.value"), "changed")
    )
    return both.select(
        doc, "key", change.alias("change"), F.col("_o.value").alias("old_value"), F.col("_n.value").alias("new_value")
    ).where("change IS NOT NULL")


def redact_env_line(line: Column) -> Column:
    """A line as it may be shown: secrets emptied, blanks and comments as they are."""
    text, name = F.trim(line), _env_key(line)
    return (
        F.when((text == "") | text.startswith("#"), line)
        .when(is_secret(name), F.concat(name, F.lit("=")))
        .otherwise(text)
    )


def redact_env(lines: DataFrame, doc: str, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(doc, line_no, line) with the value of every secret variable emptied."""
    return lines.select(doc, F.col(line_no).alias("line_no"), redact_env_line(col(line)).alias("line"))


def _joined_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both versions of every file (path, content), paired by path in any letter case."""
    side = lambda df, p: df.select(
        F.lower("path").alias("_path"), F.col("path").alias(p + "path"), F.col("content").alias(p + "content")
    )
    both = side(old, "o_").join(side(new, "n_"), "_path", "full_outer")
    status = F.when(F.col("o_path").isNull(), "added").when(F.col("n_path").isNull(), "removed").otherwise("common")
    return both.select(
        F.coalesce("n_path", "o_path").alias("path"), status.alias("file_status"),
        F.col("o_content").alias("old_content"), F.col("n_content").alias("new_content"),
    )


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, removed and common, by relative path. One aggregation;
    contents are not read."""
    side = lambda df, s: df.select(
        F.lower("path").alias("_path"), *[(F.col("path") if s == x else F.lit(None).cast("string")).alias(x) for x in ("o", "n")]
    )
    both = side(old, "o").unionAll(side(new, "n")).groupBy("_path").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("common")
    return both.select(F.coalesce("n", "o").alias("path"), status.alias("file_status"))


def drift_report(old: DataFrame, new: DataFrame, redact: bool = True) -> DataFrame:
    """One row per change between two trees of .json and .env files (path,
    content): (path, file_status, item, change, old_value, new_value, line).

    With ``redact`` secret values are blank, inside whole subtrees as well. A
    JSON file that cannot be read on a side where it is needed has one row of
    change ``error``, with the reasons as values; the others are reported all
    the same.
    """
    # Both versions meet with what is needed of them; what can be said of a
    # file without another shuffle is said in one pass.
    text_of = lambda df, kind: F.when(F.lower("path").endswith(kind), F.col("content"))
    files = _joined_files(*[df.select("path", text_of(df, ".json").alias("content")) for df in (old, new)])
    status, o, n = F.col("file_status"), F.col("old_content"), F.col("new_content")
    # A removed file is not read any more.
    reasons = F.when(F.col("path").endswith(".json") & (status != "removed"), F.struct(_reason(o).alias("o"), _reason(n).alias("n")))
    read = files.withColumn("why", reasons)
    unread = F.col("why.o").isNotNull() | F.col("why.n").isNotNull()
    read = read.select(
        "path", "file_status", "why", unread.alias("unread"), difference_texts(o, n, (status == "common") & ~unread & F.col("why").isNotNull()).alias("_parts")
    )
    none = F.lit(None).cast("string")
    said = lambda kind, parts, old, new: F.struct(
        F.lit(kind).alias("said"), parts.alias("path_parts"), old.alias("old"), new.alias("new")
    )
    nowhere = F.lit(None).cast("array<string>")
    no_rows = F.array().cast("array<struct<said:string,path_parts:array<string>,old:string,new:string>>")
    rows = F.concat(
        F.when(status != "common", F.array(said("file", nowhere, none, none))).otherwise(no_rows),
        F.when(F.col("unread"), F.array(said("error", nowhere, F.col("why.o"), F.col("why.n")))).otherwise(no_rows),
        F.transform("_parts", lambda p: said("part", p["path"], p["old"], p["new"])),
    )
    rows = read.select("path", "file_status", F.inline_outer(rows)).where("said IS NOT NULL")
    sides = F.concat_ws(", ", F.concat(F.lit("old: "), F.col("old")), F.concat(F.lit("new: "), F.col("new")))
    is_part = F.col("said") == "part"
    rows = rows.select(
        "path", "file_status", "path_parts", F.when(is_part, F.col("old")).alias("old"), F.when(is_part, F.col("new")).alias("new"),
        F.struct(
            "said", F.when(~is_part, F.col("old")).alias("old"), F.when(~is_part, F.col("new")).alias("new"),
            F.when(F.col("said") == "error", F.concat(F.lit("! Not read, "), sides))
            .when(status == "added", F.concat(F.lit("+ "), "path")).otherwise(F.concat(F.lit("- "), "path")).alias("line"),
        ).alias("_file"),
    )
    is_part = F.col("_file.said") == "part"
    trees = _compared(rows, ["path", "file_status", "_file"]).where(~is_part | F.col("change").isNotNull())
    values = {}
    for side in ("old", "new"):
        value, kind = F.col(side + "_value"), F.col(side + "_type")
        if redact:
            subtree = clean_json(F.when(kind.isin("object", "array"), value), deep=True)
            value = F.when(F.exists("path_parts", is_secret), F.lit("")).otherwise(F.coalesce(subtree, value))
        value = F.when(F.col(side + "_value").isNotNull(), value)
        values[side] = F.when(is_part, value).otherwise(F.col("_file." + side))
    json_rows = trees.select(
        "path", "file_status", dotted(F.col("path_parts")).alias("item"), F.when(is_part, F.col("change")).otherwise(F.col("_file.said")).alias("change"),
        values["old"].alias("old_value"), values["new"].alias("new_value"), F.when(~is_part, F.col("_file.line")).alias("_line"),
    )
    o, n, item = F.col("old_value"), F.col("new_value"), F.col("item")
    from_to = lambda label: F.concat(F.lit(f"~ Changed {label}: "), item, F.lit(" from '"), o, F.lit("' to '"), n, F.lit("'"))
    json_line = (
        F.when(F.col("change") == "added", F.concat(F.lit("+ Added Property: "), item, F.lit(" = "), n))
        .when(F.col("change") == "removed", F.concat(F.lit("- Removed Property: "), item, F.lit(" = "), o))
        .when(F.col("change") == "array", from_to("Array")).when(F.col("change") == "value", from_to("Value"))
        .otherwise(F.col("_line"))
    )
    version = lambda s, c: F.struct(F.lit(s).alias("side"), F.split(c, "\r\n|\r|\n").alias("lines"))
    env_files = _joined_files(*[df.where(F.lower("path").endswith(".env")) for df in (old, new)])
    env_lines = (
        env_files.where((status == "common") & F.col("path").endswith(".env"))
        .select("path", F.inline(F.array(version("o", "old_content"), version("n", "new_content"))))
        .select("path", "side", F.posexplode("lines").alias("line_no", "line"))
    )
    settings = env_lines.select("path", "side", "line_no", _env_key(F.col("line")).alias("key"), _env_value(F.col("line")).alias("value"))
    env = _env_changes(settings.where("key IS NOT NULL"), "path")
    shown = lambda c: F.when(F.lit(redact) & F.col(c).isNotNull() & is_secret(F.col("key")), F.lit("")).otherwise(F.col(c))
    env_rows = env.select("path", F.col("key").alias("item"), "change", shown("old_value").alias("old_value"), shown("new_value").alias("new_value"))
    env_line = (
        F.when(F.col("change") == "added", F.concat(F.lit("+ Added Variable: "), item, F.lit(" = "), n))
        .when(F.col("change") == "removed", F.concat(F.lit("- Removed Variable: "), item, F.lit(" = "), o))
        .otherwise(from_to("Variable"))
    )
    env_rows = env_rows.select("path", F.lit("common").alias("file_status"), "item", "change", "old_value", "new_value", env_line.alias("line"))
    return json_rows.withColumn("line", json_line).drop("_line").unionByName(env_rows)


def drift_files(report: DataFrame) -> DataFrame:
    """Changed files with the number of their changes; files that could not be read are not among them."""
    return report.where("change <> 'error'").groupBy("path", "file_status").agg(F.count("*").alias("n_changes"))


def clean_files(old: DataFrame, new: DataFrame, deep: bool = False, report: DataFrame | None = None) -> DataFrame:
    """Content of the added and changed files without secrets (path, content).
    A `drift_report` of the two trees saves comparing them again."""
    compared = drift_report(old, new, redact=False) if report is None else report
    changed = compared.where("file_status <> 'removed' AND change <> 'error'")
    files = new.join(changed.select("path").distinct(), "path", "left_semi")
    is_json = F.col("path").endswith(".json")
    env = F.array_join(F.transform(F.split("content", "\r\n|\r|\n"), redact_env_line), "\n")
    return files.select(
        "path", F.when(is_json, clean_json(F.when(is_json, F.col("content")), deep)).otherwise(env).alias("content")
    )
