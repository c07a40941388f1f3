"""64-bit codes of the words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words in order, number of words of each text).

    Words are runs of bytes other than ASCII blanks, A-Z lower-cased. A code is the word's polynomial over
    the 64-bit integers, scrambled; prefix sums over the whole batch give all of them in a few passes.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    data = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)  # a blank after each text
    blank = _IS_BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers_to(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER[data] + np.uint64(1)) * power, out=sums[1:])
    codes = mixed((sums[end] - sums[start]) * inverse[start])
    ends = np.cumsum(sizes)
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
    return codes, counts
