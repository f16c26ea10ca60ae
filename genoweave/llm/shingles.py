"""Word windows of a text as 64-bit hashes, vectorised over the text's bytes.

Words are runs of bytes other than ASCII white space. A window's hash is that of
its words joined by one space: a polynomial over per-byte random values, taken
as the difference of two prefix sums (modulo 2**64), then mixed.
"""

from __future__ import annotations

import numpy as np

GAMMA = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GAMMA)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = tables[0], tables[1]
    return _powers


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """The text's words as UTF-8 bytes, with A-Z in lower case if asked."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class Windows:
    """Hashes of the word windows of one text."""

    def __init__(self, words: list[bytes]) -> None:
        self.n = len(words)
        size = np.fromiter(map(len, words), np.int64, self.n)
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        raw = np.frombuffer(b" ".join(words), np.uint8)
        power, self.inverse = _power_tables(raw.size + 1)
        self.prefix = np.zeros(raw.size + 1, np.uint64)
        np.cumsum(_BYTES[raw] * power[: raw.size], out=self.prefix[1:])

    def hashes(self, k: int) -> np.ndarray:
        """One hash per window of k words, in order; empty if the text is shorter."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        a, b = self.starts[: self.n - k + 1], self.ends[k - 1 :]
        spans = (self.prefix[b] - self.prefix[a]) * self.inverse[a]
        return mix(spans + (b - a).astype(np.uint64) * GAMMA)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased text's k-word windows.

    A text of fewer words gives one hash, of all its words; one without words
    (or null) gives none.
    """
    words = words_of(text, True)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(Windows(words).hashes(min(k, len(words))))
