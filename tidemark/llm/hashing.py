"""Hashes of many byte strings at once, with numpy inside Spark tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=None)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of bytes, from which the hash of any part follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters()[data] * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def part_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the parts [start, end); equal parts have equal hashes anywhere."""
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order.

    Very long texts are taken in blocks that end between words, so that the
    arrays stay small.
    """
    block, out, at = 1 << 20, [], 0
    while at < len(text):
        end = min(len(text), at + block)
        if end < len(text):
            cut = max(text.rfind(space, at, end) for space in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut > at:
                end = cut
            else:
                after = [p for p in (text.find(space, end) for space in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
                end = min(after, default=len(text))
        data = np.frombuffer(text, np.uint8, end - at, at)
        starts, ends = word_bounds(data)
        if len(starts):
            out.append(part_hashes(prefix_sums(data), starts, ends))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


#: Bytes of short texts that are hashed together.
_TOGETHER = 1 << 18


def many_word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """`word_hashes` of each text; short texts share their passes over the bytes."""
    out, at = [], 0
    while at < len(texts):
        size, upto = len(texts[at]), at + 1
        while upto < len(texts) and size + len(texts[upto]) < _TOGETHER:
            size += len(texts[upto])
            upto += 1
        if upto == at + 1:
            out.append(word_hashes(texts[at]))
        else:
            data = np.frombuffer(b" ".join(texts[at:upto]), np.uint8)
            starts, ends = word_bounds(data)
            stops = np.cumsum([len(t) + 1 for t in texts[at:upto]])
            out += np.split(part_hashes(prefix_sums(data), starts, ends), np.searchsorted(starts, stops[:-1]))
        at = upto
    return out


def hash_sums(hashes: np.ndarray) -> np.ndarray:
    """`prefix_sums` of a sequence of hashes, such as a text's words."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes))[0][: len(hashes)], out=sums[1:])
    return sums
