"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_WORD = xxhash.xxh3_64_intdigest
_U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that order by value is as good as random."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all shingles; a text of fewer words, but not none, is one shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=_U)
    w = np.fromiter(map(_WORD, words), dtype=_U, count=len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), dtype=_U)
    for k in range(min(size, len(w))):
        h = h * _U(0x9E3779B97F4A7C15) + w[k : k + n]
    return np.unique(mixed(h))
