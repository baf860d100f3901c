"""Token counts by a linear longest-match automaton: a trie of the vocabulary with failure links.

For each trie node the failure link says where matching goes on when no edge fits, and the popped count how many pieces
are settled by going there; both are made once, level by level. A word is then read byte by byte, each byte moving down
once, so the greedy longest-match count needs time linear in the word, and no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

END = 256
_SUFFIX = "</w>"
#: Words as the vocabulary's tokenizer parts them: letters, single digits, other marks; all in lower case.
WORD = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Most distinct words whose counts a task keeps.
CACHE = 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def pieces(path: str) -> list[tuple[int, ...]]:
    """The vocabulary as byte strings; END after those that close a word. Special tokens, which texts don't spell, are left out."""
    letters = byte_letters()
    out = []
    with open(path, encoding="utf-8") as f:
        for piece in json.load(f)["model"]["vocab"]:
            ends = piece.endswith(_SUFFIX)
            out.append(tuple(letters[c] for c in (piece[: -len(_SUFFIX)] if ends else piece)) + (END,) * ends)
    return out


class LongestMatch:
    """The automaton; nodes are numbers, 0 the root. An end mark that is left alone costs nothing."""

    def __init__(self, vocabulary: list[tuple[int, ...]]):
        self.step: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for piece, cost in [*((p, 1) for p in vocabulary), ((END,), 0), *(((b,), 1) for b in range(256))]:
            at = 0
            for b in piece:
                nxt = self.step[at].get(b)
                if nxt is None:
                    nxt = self.step[at][b] = len(self.step)
                    self.step.append({})
                at = nxt
            ends[at] = cost
        self.fail, self.popped = [0] * len(self.step), [0] * len(self.step)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for b, v in self.step[u].items():
                todo.append(v)
                if v in ends:
                    self.popped[v] = ends[v]  # and the failure link is the root
                    continue
                z, n = self.fail[u], self.popped[u]
                while b not in self.step[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                self.fail[v], self.popped[v] = self.step[z][b], n

    def count(self, word: bytes) -> int:
        """Pieces of a word followed by the end mark, taking the longest that fits each time."""
        step, fail, popped = self.step, self.fail, self.popped
        u = n = 0
        for b in (*word, END):
            while b not in step[u]:
                n += popped[u]
                u = fail[u]
            u = step[u][b]
        while u:
            n += popped[u]
            u = fail[u]
        return n


class Counter:
    """Token counts of texts, each distinct space-parted chunk being counted once."""

    def __init__(self, path: str):
        import regex

        self.automaton = LongestMatch(pieces(path))
        self.words = regex.compile(WORD).findall
        self.known: dict[bytes, int] = {}

    def chunk(self, chunk: bytes) -> int:
        return sum(self.automaton.count(w.encode()) for w in self.words(chunk.decode("utf-8", "replace").lower()))

    def __call__(self, texts: list[bytes | None]) -> tuple[list[int], list[int]]:
        if len(self.known) > CACHE:
            self.known = {}
        words = [(t or b"").split() for t in texts]
        for w in set().union(*words):
            if w not in self.known:
                self.known[w] = self.chunk(w)
        get = self.known.__getitem__
        return [sum(map(get, w)) for w in words], [len(w) for w in words]


def token_counts(docs: DataFrame, vocabulary_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep with n_tokens (greedy longest-match pieces of the whole text) and n_words (its space-parted chunks).

    Null and empty texts have none of either. Very long texts count whole, chunk by chunk; an empty table gives an empty one. Rows are
    counted one by one, repeated ones equally; columns of keep that have the name of a result are replaced, other names never clash.
    """

    def make():
        counter = Counter(vocabulary_path)
        return lambda texts: list(counter(texts))

    return map_text(docs, make, [T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType())], keep, text_col)
