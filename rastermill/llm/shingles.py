"""Hashes of a text's word shingles, which both near-duplicate modules are made of."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words joined by spaces, repeats included; a shorter text is one run, a wordless one has none.

    A-Z become a-z; words are parted by space and U+0009..U+000D.
    """
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))[: len(words) - width + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts, stops[width - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(h: np.ndarray, block: int = 1 << 15) -> int:
    """64 bits: one is set if it is set in over half of the hashes; 0 without hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), block):
        votes += np.unpackbits(h[at : at + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")
