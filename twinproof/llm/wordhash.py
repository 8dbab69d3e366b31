"""Word and window hashes of many whole texts at once, vectorised over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at a time.
PIECE = 1 << 19
#: The ASCII controls 9 to 13 as spaces, all else unchanged.
PLAIN = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(1, n), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Polynomial hashes by prefix sums; words are what spaces separate after translation."""

    def __init__(self, base: int = BASE, fold: bytes = PLAIN):
        self.fold, self.base = fold, base
        self.power, self.back = powers(base, PIECE), powers(pow(base, -1, 1 << 64), PIECE)

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= PIECE:
            return self.power[:n], self.back[:n]
        return powers(self.base, n), powers(pow(self.base, -1, 1 << 64), n)

    def _spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each span, wherever it lies."""
        power, back = self._tables(len(values))
        run = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * power, out=run[1:])
        return mixed((run[ends] - run[starts]) * back[starts])

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first byte) of each word of translated bytes."""
        codes = np.frombuffer(raw, dtype=np.uint8)
        edge = np.flatnonzero(np.diff((codes != 32).astype(np.int8), prepend=0, append=0))
        return self._spans(codes.astype(np.uint64) + np.uint64(1), edge[::2], edge[1::2]), edge[::2]

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, word hashes of some texts together, words of each of them)."""
        first, held, size = 0, [], 0
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "surrogatepass").translate(self.fold)
            held.append(raw)
            size += len(raw) + 1
            if size >= PIECE or i == len(texts) - 1:
                found, starts = self.words(b" ".join(held))
                edges = np.cumsum([0, *[len(r) + 1 for r in held]])
                yield first, found, np.diff(np.searchsorted(starts, edges))
                first, held, size = i + 1, [], 0

    def windows(self, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each start on."""
        return self._spans(words, starts, starts + size) if len(starts) else np.zeros(0, dtype=np.uint64)
