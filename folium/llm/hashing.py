"""Vectorised hashes of words, word runs and byte runs over many texts at once.

Texts are laid end to end in one buffer. A polynomial hash of any stretch of it comes from running sums modulo 2 ** 64, with
powers of an odd base and of its inverse, so every word, k-gram or window of the buffer costs a few array operations.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), BASE if kind == "up" else INVERSE, U)
        steps[0] = U(1)
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Sums:
    """Running polynomial sums of an array of numbers."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((values.astype(U) + U(1)) * _power("up", n), out=self.sums[1:])
        self.down = _power("down", n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end]."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def runs(self, k: int) -> np.ndarray:
        """Hash of values[i:i+k] for every i; none if there are fewer than k values."""
        n = len(self.sums) - 1
        if n < k:
            return np.empty(0, U)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: n - k + 1])


def _kinds(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes that part words: ASCII white space; or all ASCII but letters and digits.
WHITE = _kinds([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = ~_kinds([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def words(texts: list[bytes], gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, in order, and for each text the index of its first word, with the end last."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~gaps[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return Sums(buf).of(start, end), np.searchsorted(start, begins)


def within(starts: np.ndarray, n: int, k: int) -> np.ndarray:
    """For n items dealt to texts by `starts`: whether items i to i + k - 1 lie in one text, for i up to n - k."""
    if n < k:
        return np.empty(0, bool)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return owner[: n - k + 1] == owner[k - 1 :]


def covered(starts: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n items lie in [i, i + k) for some i in starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + k, -1)
    return np.cumsum(step[:-1]) > 0
