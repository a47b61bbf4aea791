"""Words of many documents at once, as arrays: numpy over the bytes of a block of documents.

A word is ``[^\\x20\\x09-\\x0D]+``. Words are hashed to 64 bits (a polynomial over mixed bytes, then a finalizer), and
runs of words to 64 bits by prefix sums of a second polynomial, so that all runs of a length cost a few array steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
BYTES = _rng.integers(0, 1 << 64, 256, U, endpoint=False)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the place of each element among them."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(x) else np.zeros(0, bool)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def ascending(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`distinct`, of values that ascend."""
    new = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    return x[new], np.cumsum(new) - 1


@dataclass
class Words:
    """Words of the documents of a block, in order; ``first`` has the first word of each document, and the count."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def runs(self, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places of all runs of ``length`` words within a document, and their hashes."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, U)
        base = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)[salt]
        m = mix(self.hash + U((0x2545F4914F6CDD1D * (salt + 1)) & (2**64 - 1)))
        up, down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
        total = np.concatenate([np.zeros(1, U), np.cumsum(m * up, dtype=U)])
        h = mix((total[length:] - total[:-length]) * down[: n - length + 1])
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        at = np.flatnonzero(left >= length)
        return at, h[at]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def split(data: bytes | memoryview, lengths: np.ndarray, lower: bool = False, apart: np.ndarray = SPACE) -> Words:
    """The words of concatenated documents of ``lengths`` bytes each; ``lower``: A-Z as a-z; ``apart``: the bytes between
    words."""
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = LOWER[raw]
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, np.zeros(len(lengths) + 1, np.int64))
    space = apart[raw]
    opens = np.cumsum(lengths)[:-1]
    begins = ~space
    after = np.concatenate([[True], space[:-1]])
    after[opens[opens < n]] = True  # a document begins
    begins &= after
    start = np.flatnonzero(begins)
    before = np.concatenate([space[1:], [True]])
    before[opens[(opens > 0) & (opens < n)] - 1] = True
    end = np.flatnonzero(~space & before) + 1
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, np.zeros(len(lengths) + 1, np.int64))
    # within a word, byte k counts BYTES[b] * base ** k
    inside = np.repeat(start, end - start)
    letters = np.flatnonzero(~space)
    inside = letters - inside
    value = BYTES[raw[letters]] * _powers(0xA24BAED4963EE407, int(inside.max()) + 1)[inside]
    stop = np.cumsum(end - start)
    hashes = mix(np.add.reduceat(value, np.concatenate([[0], stop[:-1]])) + (end - start).astype(U))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    return Words(hashes, start, end, first)
