"""Keyword and text expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Keyword boundary and preview length.
TOKEN_PATTERN = "(?i)(^|[^a-zA-Z0-9]){}([^a-zA-Z0-9]|$)"
PREVIEW_LENGTH = 160


def clean_keywords(keywords: Sequence[str]) -> list[str]:
    """Trimmed keywords in list order, blanks left out."""
    return [k.strip() for k in keywords if k.strip()]


def escape(text: str) -> str:
    """The text as a regular expression that matches only itself."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text, flags=re.ASCII)


def keyword_test(text: Column, keyword: str, match: str = "token") -> Column:
    """Does the keyword occur, as a token or as a case-insensitive substring?"""
    if match == "token":
        return text.rlike(TOKEN_PATTERN.format(escape(keyword)))
    if match == "substring":
        return F.contains(F.lower(text), F.lit(keyword.lower()))
    raise ValueError(f"match must be 'token' or 'substring', not {match!r}")


def _trie(words: Sequence[str]) -> str:
    """The longest of some texts at a place as a regular expression in which
    texts that begin alike share their beginning."""
    node: dict = {}
    for word in sorted(set(words)):
        here = node
        for letter in word:
            here = here.setdefault(letter, {})
        here[""] = {}

    def written(here: dict) -> str:
        branches = [escape(letter) + written(below) for letter, below in here.items() if letter]
        if not branches:
            return ""
        if "" in here:
            return "(?:" + "|".join(branches) + ")?"
        return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    return written(node)


_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _folded(match: str):
    """How a keyword and a text are written before they are compared."""
    if match == "token":
        return lambda k: k.translate(str.maketrans(*_ASCII)), lambda text: F.translate(text, *_ASCII)
    if match == "substring":
        return str.lower, F.lower
    raise ValueError(f"match must be 'token' or 'substring', not {match!r}")


def _places(words: Sequence[str], match: str) -> str:
    """Pattern of a place at which one of the folded words stands, the longest as group 1."""
    inside = "[a-z0-9]"
    return f"(?<!{inside})({_trie(words)})(?!{inside})" if match == "token" else f"({_trie(words)})"


def any_keyword(text: Column, keywords: Sequence[str], match: str = "token") -> Column:
    """Does any of the keywords occur? One pass, however many there are; null text holds none."""
    of_word, of_text = _folded(match)
    words = [of_word(k) for k in clean_keywords(keywords)]
    return F.coalesce(of_text(text).rlike(_places(words, match)), F.lit(False)) if words else F.lit(False)


def keywords_found(text: Column, keywords: Sequence[str], match: str = "token") -> Column:
    """Positions in the list (from 0, blanks left out) of the keywords that
    occur, ascending. One pass over the text, however many keywords there are.

    At each place the longest keyword is looked for; those it begins with
    stand there too (as tokens only where it goes on with no letter or digit).
    """
    of_word, of_text = _folded(match)
    words = [of_word(k) for k in clean_keywords(keywords)]
    if not words:
        return F.array().cast("array<int>")

    def with_it(found: str) -> list[int]:
        whole = lambda w: w == found or match != "token" or not re.match("[a-z0-9]", found[len(w)])
        return [i for i, w in enumerate(words) if found.startswith(w) and whole(w)]

    distinct = sorted(set(words))
    meant = F.create_map(*[x for w in distinct for x in (F.lit(w), F.array(*map(F.lit, with_it(w))))])
    # Looking ahead only, so that one keyword may stand inside another.
    found = F.array_distinct(F.regexp_extract_all(of_text(text), F.lit(f"(?={_places(words, match)})"), F.lit(1)))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda w: F.element_at(meant, w)))))
    return F.coalesce(places, F.array().cast("array<int>"))


def first_keyword(text: Column, keywords: Sequence[str], match: str = "token") -> Column:
    """First keyword in list order that occurs, else null."""
    words = clean_keywords(keywords)
    if not words:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(keyword_test(text, k, match), F.lit(k)) for k in words])


def occurrences(text: Column, keyword: str) -> Column:
    """Non-overlapping, case-insensitive occurrences; null text has none."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(escape(keyword.lower()))), F.lit(0))


def preview(text: Column, n: int = PREVIEW_LENGTH) -> Column:
    """One line of at most n characters."""
    flat = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 3), F.lit("…"))).otherwise(flat)


def squeezed(text: Column) -> Column:
    """Trimmed text with every run of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def same_line(text: Column) -> Column:
    """Line as it takes part in a line comparison: trimmed, no trailing commas."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), ",+$", "")
