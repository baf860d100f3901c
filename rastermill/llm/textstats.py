"""Counts of one text that the quality operators share: exact rule counts, and the features made of them."""

from __future__ import annotations

import numpy as np


def _classes(*groups: bytes) -> np.ndarray:
    out = np.zeros((256, len(groups)))
    for k, g in enumerate(groups):
        out[np.frombuffer(g, np.uint8), k] = 1
    return out


SPACES = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
#: Bytes that start no code point, then the classes that features are made of.
_CLASSES = _classes(bytes(range(0x80, 0xC0)), SPACES, SYMBOLS, _UPPER, _DIGIT, b".,;:", b"!?", b"|", bytes(range(0xC0, 256)), b"\n", b".")

FEATURES = ["log_words", "word_length", "symbols", "upper", "digits", "punctuation", "exclamation", "pipes", "non_ascii", "dup_lines", "repeats", "distinct", "log_lines", "line_words", "top_word", "sentence_words"]


class _Ids(dict):
    def __missing__(self, key):
        self[key] = at = len(self)
        return at


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words inside windows of `width` consecutive words that occur twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for k in range(1, width):
        nxt = ids[k : k + n]
        top = int(nxt.max()) + 1
        if int(key.max()) >= (1 << 62) // top:  # would not fit: number the prefixes anew
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + nxt
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + width, bool)
    for k in range(width):
        covered[k : k + n] |= twice[:n]
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features; null counts as empty."""
    text = text or b""
    words = text.split()
    n = len(words)
    inner, spaces, symbols, upper, digits, marks, shouts, pipes, wide, newlines, stops = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES).tolist() if text else [0.0] * _CLASSES.shape[1]
    chars = int(len(text) - inner - spaces)
    seen = _Ids()
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, n)
    repeats = repeated_words(ids)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    base = (n, chars, int(symbols), dup, repeats)
    m, c = max(n, 1), max(chars, 1)
    letters = max(c - digits - marks - symbols - shouts, 1)
    top = np.bincount(ids).max() / m if n else 0.0
    return base, [np.log1p(n), chars / m, symbols / c, upper / letters, digits / c, marks / c, shouts / c, pipes / m, wide / c, dup / max(len(lines), 1), repeats / m, len(seen) / m, np.log1p(newlines), n / (newlines + 1), top, n / (stops + 1)]


def feature_matrix(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (n, 5) and features (n, len(FEATURES)) of a list of texts."""
    got = [measure(t) for t in texts]
    return np.array([g[0] for g in got], np.int64).reshape(-1, 5), np.array([g[1] for g in got], np.float64).reshape(-1, len(FEATURES))
