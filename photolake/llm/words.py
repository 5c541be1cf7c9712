"""Words of many texts at once, as arrays: places, documents and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from photolake.llm.tables import LOWER

#: Bytes of a word where words are runs of ASCII digits, letters and other than ASCII characters.
ALNUM = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 for b in range(256)])
#: Bytes of a word where ASCII white space parts words.
NO_SPACE = np.array([b not in b" \t\n\v\f\r" for b in range(256)])

#: Bytes hashed at once.
RUN = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a one-to-one map of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 64) - 1, 0x5851F42D4C957F2D, np.uint64))])
    return _POWERS


class Words(NamedTuple):
    """Words of some texts in order; ``first`` has each text's first word, and the number of words last."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, never 0; spans do not overlap and go up."""
    out = np.empty(len(start), np.uint64)
    done = np.cumsum(end - start)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + RUN, "right")))
        n = end[a:b] - start[a:b]
        total = int(n.sum())
        at = np.cumsum(n) - n
        place = np.arange(total) - np.repeat(at, n)
        value = _BYTES[data[place + np.repeat(start[a:b], n)]] * _powers(int(n.max()))[place]
        out[a:b] = np.add.reduceat(value, at) + n.astype(np.uint64) * _STEP
        a = b
    out = mixed(out)
    out[out == 0] = 1
    return out


def words_of(texts: list[str | None], kind: np.ndarray, hashes: bool = True) -> Words:
    """The words of ``texts``, A-Z lowered; a null text has none."""
    coded = [(x or "").encode() for x in texts]
    data = b"\n" + b"\n".join(coded).translate(LOWER) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    inside = kind[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    begins = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    first = np.append(np.searchsorted(start, begins), len(start))
    return Words(data, start, end, hash_spans(raw, start, end) if hashes else None, first)


def runs_of(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of at most ``most`` characters together, one text at least."""
    a = total = 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts)
