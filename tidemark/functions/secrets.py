"""Which names hold secrets, and how their values are blanked."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F

# A name that contains one of these holds a secret.
SECRET_WORDS = ("password", "secret", "token", "key")


def is_secret(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SECRET_WORDS))


def is_secret_name(name: str) -> bool:
    return any(word in name.lower() for word in SECRET_WORDS)


class _Number(str):
    """A number as it is written."""


def _members(pairs):
    if len({name for name, _ in pairs}) < len(pairs):
        raise ValueError("a name is repeated")
    return dict(pairs)


def _blank(node, deep: bool):
    if isinstance(node, dict):
        for name, value in node.items():
            if is_secret_name(name):
                if _is_text(value):
                    node[name] = ""
                elif deep:
                    node[name] = _emptied(value)
            else:
                _blank(value, deep)
    elif isinstance(node, list):
        for item in node:
            _blank(item, deep)
    return node


def _is_text(node) -> bool:
    return isinstance(node, str) and not isinstance(node, _Number)


def _emptied(node):
    if isinstance(node, dict):
        return {name: _emptied(value) for name, value in node.items()}
    if isinstance(node, list):
        return [_emptied(item) for item in node]
    return "" if _is_text(node) else node


def _written(node) -> str:
    """JSON text without spaces, numbers as they were."""
    if isinstance(node, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + _written(v) for k, v in node.items()) + "}"
    if isinstance(node, list):
        return "[" + ",".join(map(_written, node)) + "]"
    return str(node) if isinstance(node, _Number) else json.dumps(node, ensure_ascii=False)


def _not_json(text: str):
    raise ValueError(f"{text} is no JSON")


def _cleaned(text: str, deep: bool) -> str | None:
    try:
        tree = json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_not_json, object_pairs_hook=_members)
        return _written(_blank(tree, deep))
    except (ValueError, RecursionError):
        return None


def clean_json(content: Column, deep: bool = False) -> Column:
    """JSON text with blank secrets, numbers to the letter. Null where the
    text is no JSON, repeats a name in an object or is nested too deep to
    read, since its secrets cannot be told. A tree has to be put together
    again, which no built-in expression does, so this is an Arrow batch
    function; call it on the few texts that are to be written or shown.
    ``deep`` also empties every text inside secret-named objects and lists."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _cleaned(t, deep), na_action="ignore")

    return clean(content)
