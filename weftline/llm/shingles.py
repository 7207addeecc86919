"""Texts as sets of hashed three-word shingles.

Words are runs of a-z, 0-9 and ``_`` in the lower-cased text. A shingle's hash
has 32 bits: of two texts of 400 shingles, hashes of different shingles meet
once in 27,000 pairs, and then move the similarity by a four-hundredth.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = re.compile(r"[a-z0-9_]+").findall

_SEEN: dict[str, int] = {}
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose bits all depend on all others."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def word_hashes(words: list[str]) -> np.ndarray:
    seen = _SEEN
    if len(seen) > 500_000:
        seen.clear()
    out = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def runs(words: list[str]) -> np.ndarray:
    """The 64-bit hash of each run of three words; none for fewer than three."""
    if len(words) < 3:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return mix(h[:-2] * _A + (h[1:-1] ^ (h[1:-1] >> _S27)) * _B + mix(h[2:] * _C))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes (uint32); none for fewer than three words."""
    return np.unique((runs(WORDS((text or "").lower())) >> _S32).astype(np.uint32))


def signature(tokens: np.ndarray) -> int:
    """A signed 64-bit identity of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))
