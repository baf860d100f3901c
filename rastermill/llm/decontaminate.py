"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words stream through it, and at each word the
longest matching run that ends there is known; where it reaches a window's length, the window is hit, and the state
tells the items. Words that no item has break all runs, so only stretches of item words as long as the shortest window
are streamed. Items are a stated query set: they are taken in blocks of a bounded number of words, an automaton each,
and every document meets every block.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROOT, by_position, map_text

WINDOW = 10
#: Most words of items in one automaton.
BLOCK_WORDS = 200_000
#: A document more of whose words than this share are hit goes as a whole.
MOST_COVERED = 0.5

#: ASCII but letters and digits parts words; A-Z becomes a-z; bytes of other characters stay.
_TABLE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the root, and no edge leads to it.

    Once built it is flat: edges as ascending numbers (state * width + word) with their targets, names as slices of one array.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ids = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for name, words in items if words]
        for _, seq in ids:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.shortest = min((min(len(s), window) for _, s in ids), default=0)
        n = len(self.link)
        names: list[set[int]] = [set() for _ in range(n)]
        self.items = [name for name, _ in ids]
        self.whole: dict[int, list[tuple[int, str]]] = {}  # items shorter than a window, by the state that they end in
        for at, (name, seq) in enumerate(ids):
            s, size = 0, 0
            for c in seq:
                s, size = self.next[s][c], size + 1
                while size >= window and self.length[self.link[s]] >= window:
                    s = self.link[s]
                    size = self.length[s]
                if size >= window:
                    names[s].add(at)
            if len(seq) < window:
                s = 0
                for c in seq:
                    s = self.next[s][c]
                self.whole.setdefault(s, []).append((len(seq), name))
        self.at_window, self.short = array("i", [-1]) * n, bytearray(n)
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.at_window[s] = self.at_window[up] if self.length[up] >= window else s if self.length[s] >= window else -1
            self.short[s] = s in self.whole or self.short[up]
        self.width = len(self.vocabulary) + 1
        edges = sorted((s * self.width + c, t) for s, out in enumerate(self.next) for c, t in out.items())
        self.edges, self.targets = array("q", [e for e, _ in edges]), array("i", [t for _, t in edges])
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.first_name = array("i", [0, *np.cumsum([len(x) for x in names]).tolist()])
        self.name = array("i", [k for x in names for k in sorted(x)])
        del self.next

    def step(self, s: int, c: int) -> int:
        """The state after word c in state s, 0 for none."""
        e = s * self.width + c
        at = bisect_left(self.edges, e)
        return self.targets[at] if at < len(self.edges) and self.edges[at] == e else 0

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the shorter runs that end as p's do with c after them."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of item words (id above 0) that are as long as the shortest window."""
        if len(ids) < self.shortest or not self.shortest:
            return
        known = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
        turn = np.flatnonzero(np.diff(known))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            if b - a >= self.shortest:
                yield a, b

    def scan(self, words: list[bytes], hits: np.ndarray, found: set[str]) -> None:
        """Adds 1 where a hit starts and takes 1 where it has ended, in hits (length n + 1); adds items to found."""
        if not self.shortest or not words:
            return
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        window, link, length, step = self.window, self.link, self.length, self.step
        for a, b in self.stretches(ids):
            s = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                t = step(s, c)
                while s and not t:
                    s = link[s]
                    size = length[s]
                    t = step(s, c)
                s = t
                size = size + 1 if s else 0
                if size >= window:
                    hits[i - window] += 1
                    hits[i] -= 1
                    w = self.at_window[s]
                    found.update(self.items[k] for k in self.name[self.first_name[w] : self.first_name[w + 1]])
                if s and self.short[s]:
                    t = s
                    while t > 0:
                        for n, name in self.whole.get(t, ()):
                            if n <= size:
                                hits[i - n] += 1
                                hits[i] -= 1
                                found.add(name)
                        t = link[t]


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """Broadcast automata of the items, a block of about block_words words each. Items with no words are in none.

    Items are dealt to blocks by hash, and a task builds each block's automaton, with about a thousand bytes a word meanwhile.
    The driver takes the finished ones one by one. Each Python worker holds all of them, at about 130 bytes a word of the
    benchmark: benchmarks are small beside the corpus, but one of ten million words needs 1.3 GB in each.
    """
    sc = items.sparkSession.sparkContext
    sc.environment.setdefault("PYTHONPATH", ROOT)
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("string").alias("said")).where("said is not null")
    total = own.agg(F.sum(F.size(F.split("said", r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")))).first()[0] or 0

    def build(block: pd.DataFrame) -> pd.DataFrame:
        made = Automaton([(name, words_of(said.encode("utf-8", "surrogatepass"))) for name, said in sorted(zip(block["name"], block["said"]))], window)
        return pd.DataFrame({"made": [pickle.dumps(made)] if made.shortest else []})

    dealt = own.groupBy(F.pmod(F.xxhash64("name", "said"), F.lit(-(-total // block_words) or 1)).alias("block"))
    return [sc.broadcast(pickle.loads(r[0])) for r in dealt.applyInPandas(build, "made binary").toLocalIterator()]


def _hits(text: bytes | None, blocks: list[Automaton]) -> tuple[list[bytes], np.ndarray, set[str]]:
    words, found = words_of(text), set()
    turns = np.zeros(len(words) + 1, np.int64)
    for a in blocks:
        a.scan(words, turns, found)
    return words, np.cumsum(turns[:-1]) > 0, found


def contamination(docs: DataFrame, blocks: list, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep with n_words, n_hit, n_items, items_sha256 and contaminated.

    Null and wordless texts have no words and no hits; items_sha256 is then that of the empty text. An item_id that
    repeats counts once, a null one as the empty string. Texts are read whole, row by row, so repeated rows get equal
    results; an empty table gives an empty one; columns of keep that have the name of a result are replaced.
    """

    def make():
        held = [b.value for b in blocks]

        def run(texts):
            out = []
            for t in texts:
                words, hit, found = _hits(t, held)
                n = int(hit.sum())
                out.append((len(words), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0))
            return list(zip(*out)) if out else [[]] * 5

        return run

    kinds = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]
    return map_text(docs, make, [T.StructField(n, k) for n, k in kinds], keep, text_col)


def clean(text: bytes, blocks: list[Automaton], most_covered: float = MOST_COVERED) -> bytes | None:
    """The text without its hit spans, again until nothing is hit; None if more than most_covered of its words were hit.

    A span goes with the characters up to the next word that stays.
    """
    total = gone = 0
    while True:
        words, hit, _ = _hits(text, blocks)
        total = total or len(words)
        if not hit.any():
            return text
        gone += int(hit.sum())
        if gone > most_covered * total:
            return None
        s = text.decode("utf-8", "surrogatepass")
        starts = [m.start() for m in _WORD.finditer(s)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        parts, at = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            parts.append(s[at : starts[a]])
            at = starts[b] if b < len(starts) else len(s)
        text = "".join([*parts, s[at:]]).encode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, blocks: list, text_col: str = "text", chars_col: str | None = "n_chars", most_covered: float = MOST_COVERED) -> DataFrame:
    """docs without hit spans: rows that are hit in more than most_covered of their words go, others lose their spans.

    All columns stay, whatever their names; chars_col, where docs has it, is counted anew for changed texts. Rows that are not
    hit stay as they are, null texts among them; repeated rows fare alike, and an empty table stays empty.
    """

    def make():
        held = [b.value for b in blocks]

        def run(texts):
            new = [None if t is None else clean(t, held, most_covered) for t in texts]
            return [[None if n is None or n is t else n.decode("utf-8", "surrogatepass") for n, t in zip(new, texts)], [t is not None and n is None for n, t in zip(new, texts)]]

        return run

    own, (text,) = by_position(docs, text_col)
    got = map_text(own, make, [T.StructField("new", T.StringType()), T.StructField("gone", T.BooleanType())], own.columns, text).where("not gone")
    put = {text: F.coalesce("new", text)}
    if chars_col in docs.columns:
        chars = f"c{docs.columns.index(chars_col)}"
        put[chars] = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars))
    return got.withColumns(put).select(*own.columns).toDF(*docs.columns)
