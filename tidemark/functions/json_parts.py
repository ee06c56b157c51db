"""Where the parts of JSON texts stand: names and raw texts, found in one pass.

What is found are pieces of the text as it is written; whether a text is JSON,
and what a piece means, is for Spark's JSON reader. The work is linear in the
text, whatever its depth, which taking a tree apart level by level is not: each
level would copy all that lies below it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

# A value or a bracket, with the name before it if there is one.
_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_VALUES = re.compile(rf'(?:({_STRING})\s*:\s*)?({_STRING}|[{{}}\[\]]|[^\s{{}}\[\],:"]+)', re.DOTALL)


def _name(token: str) -> str:
    if "\\" not in token:
        return token[1:-1]
    # Half a character cannot be written; Spark puts a question mark as well.
    return json.loads(token, strict=False).encode("utf-8", "replace").decode("utf-8")


def _leaves(text: str, into_arrays: bool) -> Iterator[tuple]:
    """(path, text) of everything that is not a non-empty object. Lists are
    leaves, or with ``into_arrays`` have their items as members, the index as
    name."""
    path: list[str] = []
    members: list[int] = []  # of the objects and lists that are open
    begin = inside = 0  # a list that stays whole, and the brackets open in it
    for found in _VALUES.finditer(text):
        name, value = found.groups()
        first = value[0]
        if inside:
            inside += (first in "[{") - (first in "]}")
            if not inside:
                yield path[:], text[begin:found.end()]
                if members:
                    path.pop()
        elif first in "]}":
            if not members.pop():
                yield path[:], "{}" if first == "}" else "[]"
            if members:
                path.pop()
        else:
            if members:
                path.append(str(members[-1]) if name is None else _name(name))
                members[-1] += 1
            if first == "{" or (first == "[" and into_arrays):
                members.append(0)
            elif first == "[":
                begin, inside = found.start(2), 1
            else:
                yield path[:], value
                if members:
                    path.pop()


class _Node:
    """A value: where it stands, and its members if it is an object."""

    __slots__ = ("start", "end", "members")

    def __init__(self, start: int, end: int, members: dict | None):
        self.start, self.end, self.members = start, end, members


def _tree(text: str) -> _Node:
    """Tree of the objects of a text; lists are not taken apart."""
    root, above, inside = None, [], 0
    for found in _VALUES.finditer(text):
        name, value = found.groups()
        first = value[0]
        if inside:
            inside += (first in "[{") - (first in "]}")
            if not inside:
                node.end = found.end()
        elif first == "}":
            above.pop().end = found.end()
        else:
            node = _Node(found.start(2), found.end(), {} if first == "{" else None)
            if above:
                above[-1].members[_name(name)] = node
            else:
                root = node
            if first == "{":
                above.append(node)
            inside = int(first == "[")
    return root


def _differences(old: str | None, new: str | None) -> Iterator[tuple]:
    """(path, old text, new text) of the parts that are not written alike,
    objects on both sides member by member; null is a part that is not there."""
    if old is None or new is None:
        yield [], old, new
        return
    if old == new:
        return
    piece = lambda text, node: None if node is None else text[node.start:node.end]
    todo = [([], _tree(old), _tree(new))]
    while todo:
        path, o, n = todo.pop()
        if o is not None and n is not None and o.members is not None and n.members is not None:
            todo.extend((path + [name], o.members.get(name), n.members.get(name)) for name in {**o.members, **n.members})
        elif (o_text := piece(old, o)) != (n_text := piece(new, n)):
            yield path, o_text, n_text


def _lists(rows: Iterable[Iterable[tuple]], names: tuple[str, ...]) -> pa.Array:
    """One list of (path, texts) structs per row."""
    ends, path_ends, path_names, texts = [0], [0], [], [[] for _ in names]
    for row in rows:
        for path, *pieces in row:
            path_names += path
            path_ends.append(len(path_names))
            for column, piece in zip(texts, pieces):
                column.append(piece)
        ends.append(len(path_ends) - 1)
    paths = pa.ListArray.from_arrays(pa.array(path_ends, pa.int32()), pa.array(path_names, pa.string()))
    parts = pa.StructArray.from_arrays([paths, *(pa.array(t, pa.string()) for t in texts)], names=["path", *names])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)


def leaf_texts(text: Column, is_json: Column, into_arrays: bool) -> Column:
    """Array of (path, text) of the leaves of a JSON text, empty where
    ``is_json`` is not true. A null text is one leaf without text."""

    @F.arrow_udf("array<struct<path:array<string>,text:string>>")
    def leaves(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        def of(text, is_wanted):
            return () if not is_wanted else [([], None)] if text is None else _leaves(text, into_arrays)

        return _lists(map(of, texts.to_pylist(), wanted.to_pylist()), ("text",))

    return leaves(text, is_json)


def difference_texts(old: Column, new: Column, are_json: Column) -> Column:
    """Array of (path, old, new) of the parts of two JSON texts that are not
    written alike: members on one side only, and what is not an object on
    both. Empty where ``are_json`` is not true."""

    @F.arrow_udf("array<struct<path:array<string>,old:string,new:string>>")
    def differences(olds: pa.Array, news: pa.Array, wanted: pa.Array) -> pa.Array:
        of = lambda o, n, is_wanted: _differences(o, n) if is_wanted else ()
        return _lists(map(of, olds.to_pylist(), news.to_pylist(), wanted.to_pylist()), ("old", "new"))

    return differences(old, new, are_json)
