"""Log and script lines: (doc, line_no, line) frames, batch or streaming."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import any_of, col
from tidemark.functions.text import squeezed
from tidemark.operators.rules import DROP_RULES, INLINE_REWRITES, SAFE_RUN_REWRITES, DropRule, RewriteRule
from tidemark.operators.signatures import DECLARED, SIGNATURES
from tidemark.session import checkpointed

# Patterns of a psql log and marks of its classes.
LOG_LEVEL = r"(?i)^psql:.+?:(\d+):\s*(NOTICE|ERROR|WARNING|INFO|CONTEXT):\s*(.*)$"
LOG_OTHER = r"(?i)^psql:.+?:(\d+):\s*(.*)$"
LOG_NOISE = (
    r"(?i)^(BEGIN|COMMIT|ROLLBACK|SET|GRANT|REVOKE|ANALYZE|VACUUM|INSERT \d+ \d+|UPDATE \d+|DELETE \d+|SELECT \d+|"
    r"COPY \d+|COMMENT|DO|(CREATE|ALTER|DROP) [A-Z ]+)$"
)
ERROR_MARKS = ("error:", "❌", "[error]")
WARNING_MARKS = ("warning:", "⚠️", "[warning]")
SUMMARY_MARKS = ("SUMMARY:", "====")
CLASS_MARKS = {
    "Errors": ("❌", "error", "failed"),
    "Success": ("✅", "success"),
    "Info": ("⚡", "⌛", "[info]", "[cmd]", "pg_restore"),
}

# Lines of one text that one task looks through.
CHUNK_LINES = 100_000
# Lines whose states are noted together, and chunks that are folded into one.
STATE_LINES = 64
FAN = 64


def _has(text: Column, marks: Sequence[str]) -> Column:
    return any_of(F.contains(text, F.lit(m)) for m in marks)


def normalize_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log lines without file names, noise lines left out.

    ``psql:<file>:<n>: LEVEL: text`` becomes ``[LEVEL] Line n: text``, other
    psql lines ``Line n: text``; lines of other programs stay as they are.
    """
    text = F.trim(col(line))
    level = F.upper(F.regexp_extract(text, LOG_LEVEL, 2))
    part = lambda pattern, group: F.regexp_extract(text, pattern, group)
    clean = (
        F.when(text.rlike(LOG_LEVEL), F.concat(F.lit("["), level, F.lit("] Line "), part(LOG_LEVEL, 1), F.lit(": "), part(LOG_LEVEL, 3)))
        .when(text.rlike(LOG_OTHER), F.concat(F.lit("Line "), part(LOG_OTHER, 1), F.lit(": "), part(LOG_OTHER, 2)))
    )
    noise = F.coalesce(clean, text).rlike(LOG_NOISE)
    return lines.where(~noise).withColumn(line, F.coalesce(clean, col(line)))


def severity(line: Column) -> Column:
    """error, warning or other; a line that is both is an error."""
    text = F.lower(line)
    return F.when(_has(text, ERROR_MARKS), "error").when(_has(text, WARNING_MARKS), "warning").otherwise("other")


def severity_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines per severity."""
    return lines.groupBy(severity(col(line)).alias("severity")).agg(F.count("*").alias("n_lines"))


def severity_summary(lines: DataFrame, doc: str, line: str = "line") -> DataFrame:
    """Errors and warnings per document, with the closing line of its run."""
    n = lambda kind: F.sum((severity(col(line)) == kind).cast("bigint"))
    counts = lines.groupBy(doc).agg(n("error").alias("errors"), n("warning").alias("warnings"))
    word = F.when(F.col("errors") == 0, "completed successfully").otherwise("completed with errors")
    text = F.concat(
        F.lit("SUMMARY: "), word, F.lit(". Errors: "), F.col("errors"), F.lit(", Warnings: "), F.col("warnings")
    )
    return counts.withColumn("summary", text)


def filter_log(lines: DataFrame, text: str = "", kind: str = "All", line: str = "line") -> DataFrame:
    """Lines that contain the text, in any letter case, and belong to the
    class All, Errors, Success or Info; summary lines are in no class."""
    if kind != "All" and kind not in CLASS_MARKS:
        raise ValueError(f"unknown class {kind!r}")
    lower = F.lower(col(line))
    if text:
        lines = lines.where(F.contains(lower, F.lit(text.lower())))
    if kind != "All":
        lines = lines.where(_has(lower, CLASS_MARKS[kind]) & ~_has(col(line), SUMMARY_MARKS))
    return lines


def signature_scan(
    lines: DataFrame,
    doc: str,
    signatures: Mapping[str, str] = SIGNATURES,
    max_lines: int | None = None,
    line_no: str = "line_no",
    line: str = "line",
) -> DataFrame:
    """(doc, name, first_line) of every signature that occurs in a text and
    of every extension it declares. ``max_lines`` looks at the first lines
    only; by default at all."""
    if max_lines is not None:
        lines = lines.where(col(line_no) <= max_lines)
    declared = F.regexp_extract(col(line), "(?i)" + DECLARED, 1)
    # Words are looked for before a pattern is tried: most lines hold none.
    lines = lines.select(doc, line_no, line, F.lower(col(line)).alias("_lower"))
    words = {name: leading_words(pattern) for name, pattern in signatures.items()}
    names = [F.when(F.contains("_lower", F.lit("extension")) & (declared != ""), F.lower(F.trim(declared)))]
    for name, pattern in signatures.items():
        test = col(line).rlike("(?i)" + pattern)
        names.append(F.when(_has(F.col("_lower"), words[name]) & test if words[name] else test, F.lit(name)))
    found = lines.select(doc, line_no, F.explode(F.array_compact(F.array(*names))).alias("name"))
    return found.groupBy(doc, "name").agg(F.min(line_no).alias("first_line"))


def leading_words(pattern: str) -> list[str]:
    """Words of which one is in every text the pattern matches, when each of
    its alternatives starts with a word; empty when that cannot be told."""
    alternatives, depth = [""], 0
    for c in pattern:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and depth == 0:
            alternatives.append("")
        else:
            alternatives[-1] += c
    words = []
    for text in alternatives:
        found = re.match(r"\\b([a-z0-9_]+)([?*{]?)", text)
        word = found[1][:-1] if found and found[2] else found[1] if found else ""
        if not word:
            return []
        words.append(word)
    return words


def copy_start(line: Column) -> Column:
    return F.trim(line).rlike(r"(?i)^COPY .*FROM stdin")


def copy_end(line: Column) -> Column:
    return F.trim(line) == "\\."


def insert_start(line: Column) -> Column:
    return F.trim(line).rlike("(?i)^INSERT INTO ")


def statement_end(line: Column) -> Column:
    return F.trim(line).endswith(";")


def drop_marked_regions(
    lines: DataFrame,
    doc: str,
    start: Column,
    end: Column,
    line_no: str = "line_no",
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """Lines outside regions that go from a start line through the next end
    line; a region without end goes to the end of its text, and a start line
    that is also an end is a region of its own.

    A line is inside when the last mark before it is a start. Texts are looked
    through in chunks, and what the earlier chunks end with is handed on, so a
    very long text is spread over many tasks.
    """
    window = Window.partitionBy(doc, "_chunk").orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("_chunk", F.floor(col(line_no) / F.lit(chunk_lines))).withColumn(
        "_starts", F.coalesce(start, F.lit(False))
    ).withColumn("_mark", F.when(end, F.lit(False)).when(F.col("_starts"), F.lit(True)))
    last_mark = F.max(F.when(F.col("_mark").isNotNull(), F.struct(col(line_no), F.col("_mark"))))
    earlier = Window.partitionBy("_doc").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        marked.groupBy(F.col(doc).alias("_doc"), F.col("_chunk").alias("_c")).agg(last_mark["_mark"].alias("_last"))
        .withColumn("_begins", F.last("_last", ignorenulls=True).over(earlier))
        .where("_begins").drop("_last")
    )
    state = marked.withColumn("_before", F.last("_mark", ignorenulls=True).over(window))
    on = (F.col(doc) == F.col("_doc")) & (F.col("_chunk") == F.col("_c"))
    inside = F.coalesce("_before", "_begins", F.lit(False))
    return state.join(begins, on, "left_outer").where(~inside & ~F.col("_starts")).select(*[col(c) for c in lines.columns])


# States while a script is read, and what a line can do, as bits.
OUTSIDE, IN_COPY, IN_INSERT = 0, 1, 2
_COPY, _COPY_END, _INSERT, _END = 1, 2, 4, 8


def _after(state: int, marks: int) -> int:
    """State after a line with these marks."""
    if state == IN_COPY:
        return OUTSIDE if marks & _COPY_END else IN_COPY
    if state == IN_INSERT:
        return OUTSIDE if marks & _END else IN_INSERT
    if marks & _COPY:
        return IN_COPY
    return IN_INSERT if marks & _INSERT and not marks & _END else OUTSIDE


def _step(state: Column, marks: Column) -> Column:
    """`_after` as a look-up."""
    table = F.array(*[F.lit(_after(s, m)) for s in range(3) for m in range(16)])
    return F.get(table, state * 16 + marks)


def _folded(chunks: DataFrame, fan: int) -> DataFrame:
    """Runs of `fan` neighbouring chunks as one: (_doc, _n, _parts, _to), with
    where the parts together lead to from each state."""
    parts = chunks.groupBy("_doc", F.floor(F.col("_n") / F.lit(fan)).alias("_n")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("_to").alias("to")))).alias("_parts")
    )
    ends = [F.aggregate("_parts", F.lit(s), lambda state, x: F.get(x["to"], state)) for s in range(3)]
    return parts.withColumn("_to", F.array(*ends))


def _first_states(chunks: DataFrame, fan: int) -> DataFrame:
    """(_doc, _n, _first): the state every chunk begins with.

    What chunks lead to is folded by `fan` until one run is left of each text,
    and the states go down the same way. Each level has one in `fan` of the
    rows of the one below, so the work is linear in the chunks, and no task
    holds more than `fan` of them for a text.
    """
    last = chunks.agg(F.max("_n")).first()[0] or 0
    levels = [_folded(chunks, fan)]
    while last >= fan:
        last //= fan
        levels.append(_folded(levels[-1].select("_doc", "_n", "_to"), fan))
    begun = levels[-1].select("_doc", "_parts", F.lit(OUTSIDE).alias("_first"))
    for below in [*reversed(levels[:-1]), None]:
        empty = F.struct(F.col("_first").alias("state"), F.array().cast("array<int>").alias("seen"))
        firsts = F.aggregate("_parts", empty, lambda acc, x: F.struct(
            F.get(x["to"], acc["state"]).alias("state"), F.array_append(acc["seen"], acc["state"]).alias("seen")
        ))["seen"]
        states = begun.select("_doc", F.inline(F.arrays_zip(F.col("_parts")["n"].alias("n"), firsts.alias("first")))).toDF("_doc", "_n", "_first")
        if below is not None:
            upper = states.toDF("_d", "_up", "_first")
            begun = below.join(upper, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_n") == F.col("_up"))).select("_doc", "_parts", "_first")
    return states


def drop_data(
    lines: DataFrame, doc: str, line_no: str = "line_no", line: str = "line", chunk_lines: int = STATE_LINES, fan: int = FAN
) -> DataFrame:
    """Script lines without COPY blocks and without INSERT statements.

    One pass: inside a statement a line that looks like another's start is
    text. What a line can do is folded over chunks of a text, chunks are
    folded by `fan` in as many levels as they need (`_first_states`), and
    each line looks up the state its chunk noted for it: a text of any length
    is spread over many tasks, its lines move once, and only JVM functions see
    them. The chunks' marks are written between. Lines of no document are one
    text; a line without number is dropped only for what itself begins.
    """
    bits = ((copy_start(col(line)), _COPY), (copy_end(col(line)), _COPY_END), (insert_start(col(line)), _INSERT), (statement_end(col(line)), _END))
    marks = sum((F.when(F.coalesce(test, F.lit(False)), bit).otherwise(0) for test, bit in bits), F.lit(0))
    chunk = F.floor(col(line_no) / F.lit(chunk_lines))
    place = F.pmod(col(line_no), F.lit(chunk_lines)).cast("int")

    # Chunks without marks are there as well: lines after a mark need not have one.
    found = lines.where(col(line_no).isNotNull()).select(col(doc).alias("_doc"), chunk.alias("_n"), place.alias("_at"), marks.alias("_marks"))
    mark = F.when(F.col("_marks") > 0, F.struct(F.col("_at").alias("at"), F.col("_marks").alias("m")))
    noted = found.groupBy("_doc", "_n").agg(F.array_sort(F.collect_list(mark)).alias("_all"))
    ends = [F.aggregate("_all", F.lit(s), lambda state, x: _step(state, x["m"])) for s in range(3)]
    chunks = checkpointed(noted.withColumn("_to", F.array(*ends)))

    # The state before each line of a chunk, as a text of digits.
    before = F.aggregate(
        "_all", F.struct(F.col("_first").alias("state"), F.lit("").alias("text")),
        lambda acc, x: F.struct(
            _step(acc["state"], x["m"]).alias("state"), F.rpad(acc["text"], x["at"] + 1, acc["state"].cast("string")).alias("text")
        ),
        lambda acc: F.rpad(acc["text"], F.lit(chunk_lines), acc["state"].cast("string")),
    )
    firsts = _first_states(chunks.select("_doc", "_n", "_to"), fan).toDF("_d", "_c", "_first")
    states = chunks.join(firsts, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_n") == F.col("_c"))).select("_doc", "_n", before.alias("_states"))
    busy = states.where(F.col("_states").rlike("[^0]"))

    opens = marks.bitwiseAND(F.lit(_COPY | _INSERT)) != 0
    kept = lines.where(~opens).join(busy, col(doc).eqNullSafe(F.col("_doc")) & (chunk == F.col("_n")), "left_outer")
    state = F.substr(F.col("_states"), place + 1, F.lit(1))
    return kept.where(F.col("_states").isNull() | (state == F.lit(str(OUTSIDE)))).select(*[col(c) for c in lines.columns])


# What comments may not be looked for in, then the comments.
_COMMENT = r"""('(?:[^']|'')*'|"[^"]*"|\$(\w*)\$[\s\S]*?\$\2\$)|--[^\n]*|/\*[\s\S]*?\*/"""


def without_comments(text: Column) -> Column:
    """Statement text without -- and /* */ comments; those marks stay inside
    quoted text, quoted names and dollar-quoted bodies."""
    return F.regexp_replace(text, _COMMENT, "$1")


def _bare(text: Column) -> Column:
    return F.regexp_replace(without_comments(text), r"^\s+|\s+$", "")


def rule_filter(
    records: DataFrame, text: str, rules: Sequence[DropRule] = DROP_RULES, disabled: Sequence[str] = ()
) -> DataFrame:
    """The records with the reason of the first enabled rule that drops them,
    null for those kept. Rules see the text without comments and with white
    space squeezed."""
    clean = squeezed(without_comments(col(text)))
    reasons = [F.when(clean.rlike(r.pattern), F.lit(r.reason)) for r in rules if r.name not in set(disabled)]
    return records.withColumn("reason", F.coalesce(*reasons) if reasons else F.lit(None).cast("string"))


def _rewrite(text: Column, rule: RewriteRule) -> Column:
    new = F.regexp_replace(text, rule.pattern, rule.replacement)
    return F.when(_bare(text).rlike(rule.unless), text).otherwise(new) if rule.unless else new


def rule_rewrite(
    records: DataFrame,
    text: str,
    inline: Sequence[RewriteRule] = INLINE_REWRITES,
    chain: Sequence[RewriteRule] = (),
) -> DataFrame:
    """The records with ``rewritten`` text and whether it is ``modified``
    apart from white space. All inline rules are applied, then the first rule
    of the chain (such as `SAFE_RUN_REWRITES`) that fits. Comments do not keep
    a rule from fitting, and stay."""
    new = col(text)
    for rule in inline:
        fits = _bare(new).rlike(rule.when)
        new = F.when(fits, _rewrite(new, rule)).otherwise(new) if rule.when else _rewrite(new, rule)
    out = records.withColumn("rewritten", new)
    if chain:
        plain = _bare(F.col("rewritten"))
        chosen = F.coalesce(*[F.when(plain.rlike(r.when), _rewrite(F.col("rewritten"), r)) for r in chain])
        out = out.withColumn("rewritten", F.coalesce(chosen, F.col("rewritten")))
    return out.withColumn("modified", squeezed(col(text)) != squeezed(F.col("rewritten")))


def rule_audit(records: DataFrame, text: str = "text") -> DataFrame:
    """Records per action and reason, over `rule_filter` and `rule_rewrite`
    columns; blank records are not counted."""
    emptied = squeezed(F.col("rewritten")) == ""
    action = (
        F.when(F.col("reason").isNotNull() | emptied, "ignored").when(F.col("modified"), "modified").otherwise("unchanged")
    )
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(emptied, "Statement became empty after processing")
    return (
        records.where(squeezed(col(text)) != "")
        .groupBy(action.alias("action"), F.coalesce(reason, F.lit("")).alias("reason"))
        .agg(F.count("*").alias("n_records"))
    )

