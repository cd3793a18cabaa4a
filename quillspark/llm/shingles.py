"""Word and shingle hashing over Arrow batches, whole texts, no Python loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; as those bytes never occur inside a multi-byte UTF-8
sequence, this is the same as the pattern ``[^\\x20\\x09-\\x0D]+`` over code points.  A word's 64-bit hash is a
polynomial over random byte values, finished by a bijective mixer; a shingle's hash mixes its words' hashes in order.
Two different word sequences collide with a probability of about 2**-60 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 19
#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions) and hash of each word of the bytes ``data``."""
    if not len(data):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    value = (_BYTE[_LOWER] if lower else _BYTE)[data]
    value *= _powers(_BASE, len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    back = _powers(_INVERSE, len(data) + 1)
    return start, end, mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x100000001B3) + words[k : n + k])
    return out


def release() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and an executor's memory counts what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def released(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f``, with the memory it has freed given back."""

    @wraps(f)
    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            release()

    return run


def slices(batch):
    """An Arrow batch in parts of SLICE rows, so that few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)
    release()


def steps(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of at most STEP_BYTES, or of one text."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if i > begin and size + n > STEP_BYTES:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def token_sets(texts: list[bytes | None], width: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in the order of ``texts``.

    A text of fewer words, if it has any, has one token: the whole sequence.  A null or wordless text has none.
    """
    for begin, stop in steps(texts):
        part = [t or b"" for t in texts[begin:stop]]
        data = np.frombuffer(b"\n".join(part), np.uint8)
        at = np.cumsum([0, *(len(t) + 1 for t in part)])
        start, _, words = word_hashes(data, lower)
        shingles = windows(words, width)
        cut = np.searchsorted(start, at)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(shingles[a : b - width + 1])
            elif b > a:
                yield windows(words[a:b], b - a)
            else:
                yield np.empty(0, np.uint64)
