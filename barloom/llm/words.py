"""Words and shingles of a text as 64-bit numbers, computed over the whole UTF-8 buffer at once.

A-Z is lower-cased; words are the runs between the characters x20 and x09-x0D. All arithmetic wraps at 64 bits.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bytes hashed at once; longer texts are cut at a blank.
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_state: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, at least ``n`` of each."""
    if len(_state.get("up", ())) < n:
        size = max(n, 1 << 16, 2 * len(_state.get("up", ())))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _state[name] = np.multiply.accumulate(steps)
    return _state["up"], _state["down"]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if "codes" not in _state:
        _state["codes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        blank = np.zeros(256, bool)
        blank[[0x20, *range(0x09, 0x0E)]] = True
        _state["blank"] = blank
    return _state["codes"], _state["blank"]


#: ASCII punctuation becomes blank under this table.
PLAIN = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def words(text: str | None, table: bytes | None = None, fold: bool = True) -> np.ndarray:
    """One number per word, in order; ``table`` first replaces bytes; without ``fold`` letters keep their case."""
    raw = (text or "").encode("utf-8", "replace")
    if fold:
        raw = raw.lower()  # bytes: only A-Z change
    if table is not None:
        raw = raw.translate(table)
    if len(raw) <= PART:
        return _words(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PART)
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(_words(raw[at:end]))
        at = end
    return np.concatenate(parts)


def _words(raw: bytes) -> np.ndarray:
    codes, blank = _tables()
    data = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero(blank[data])
    before = np.concatenate(([-1], gaps))
    after = np.concatenate((gaps, [len(data)]))
    some = after - before > 1
    starts, ends = before[some] + 1, after[some]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def windows(numbers: np.ndarray, size: int) -> np.ndarray:
    """One number per run of ``size`` neighbours."""
    count = len(numbers) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    up, _ = powers(size)
    total = numbers[:count].copy()
    for k in range(1, size):
        total += numbers[k:k + count] * up[k]
    return mix(total + np.uint64(size))


class Spans:
    """Numbers for any runs of neighbours, from prefix sums, whatever their length."""

    def __init__(self, numbers: np.ndarray) -> None:
        up, self._down = powers(len(numbers) + 1)
        self._sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(numbers * up[:len(numbers)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self._sums[start + size] - self._sums[start]) * self._down[start] + np.asarray(size).astype(np.uint64))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles; with fewer words the whole sequence as one; nothing without words."""
    found = words(text)
    if not len(found):
        return found
    return np.unique(windows(found, min(size, len(found))))
