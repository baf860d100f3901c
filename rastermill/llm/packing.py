"""Packing of token streams into sequences by order-preserving dynamic programming.

Within a partition the documents' ids form one stream in the order of the rows. Places where a sequence may end are
document ends (free), sentence ends (a small penalty), and, where these lie far apart, places in between (a larger
one). The cheapest cuts minimise padding plus penalties: a sequence from i to j costs limit - (j - i), or nothing if
its length is a power of two, plus the penalty of j. The least cost over the window of possible i is the head of a
monotone queue of cost(i) + i; the few i at a power of two before j are looked up beside it.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ROOT
from .tokencount import byte_letters

LIMIT = 2048
END = 1
#: The tokenizer's own pattern for the parts of a text. Fixed value.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SENTENCE_COST, INNER_COST, SEQUENCE_COST = 2.0, 12.0, 8.0
#: Lengths of sequences that need no padding, as far as worth a look.
POWERS = [1 << k for k in range(4, 12)]
#: Without a sentence end for so many tokens, a cut is allowed.
STRIDE = 64
#: Tokens that are cut at once.
BLOCK = 1 << 20
#: Chunks and parts whose ids are kept, twice over at most.
CACHE = 300_000


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    """Ids by chunk; what is not there comes from the older ones or is made, and is kept."""

    def __init__(self, make, older):
        self.make, self.older = make, older

    def __missing__(self, chunk):
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        self[chunk] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, by way of the ids of their words.

    The tokenizer parts text at white space and keeps none of it, so a text's ids are those of its chunks between ASCII
    spaces in turn. A chunk of Latin letters is lower-cased and parted by the tokenizer's own pattern, and its parts go
    to the tokenizer's model; any other chunk goes through the whole tokenizer. Ids of chunks and parts are kept: the
    newest CACHE of them and those before.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts = regex.compile(PARTS).findall
        self.letters = {b: c for c, b in byte_letters().items()}
        self.known = _Known(self.chunk, {})
        vocabulary = self.tokenizer.get_vocab()
        self.stop = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a sentence
        self.stop[[i for piece, i in vocabulary.items() if piece.endswith("</w>") and not piece[:-4].strip(".!?")]] = True

    def part(self, word: str) -> bytes:
        spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(spelt)])

    def chunk(self, chunk: bytes) -> bytes:
        known, low = self.known, chunk.lower()
        if low.isalpha():
            return known[low] if low != chunk else self.part(low.decode())
        if low[-1] in b".,;:" and low[:-1].isalpha():
            return known[low[:-1]] + known[low[-1:]]
        s = chunk.decode("utf-8", "replace")
        if max(s) >= "\u0250" or "<|" in s:
            return _packed(self.tokenizer.encode(s, add_special_tokens=False).ids)
        return b"".join([self.part(p) if len(q := p.encode()) == len(chunk) else known[q] for p in self.parts(s.lower())])

    def __call__(self, texts: list[bytes | None]) -> list[tuple[bytes, np.ndarray]]:
        """(ids, token counts after each sentence end inside the text) of each text."""
        if len(self.known) > CACHE:
            self.known = _Known(self.chunk, dict(self.known))
        get, out = self.known.__getitem__, []
        for t in texts:
            ids = b"".join(map(get, (t or b"").split()))
            out.append((ids, np.flatnonzero(self.stop[np.frombuffer(ids, "<u4")]) + 1))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it keeps serves its later tasks too."""
    return Encoder(path)


def places(length: int, sentences: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Where a document of `length` tokens may be cut, with penalties; its end is the last place and free."""
    bounds = np.empty(len(sentences) + 2, np.int64)
    bounds[0], bounds[1:-1], bounds[-1] = 0, sentences, length
    gaps = np.diff(bounds)
    if gaps.min() <= 0:
        bounds = np.concatenate(([0], np.unique(sentences[(sentences > 0) & (sentences < length)]), [length]))
        gaps = np.diff(bounds)
    where, cost = bounds[1:], np.full(len(bounds) - 1, SENTENCE_COST)
    cost[-1] = 0.0
    wide = np.flatnonzero(gaps > stride)
    if len(wide):
        inner = np.concatenate([np.arange(bounds[k] + stride, bounds[k + 1], stride) for k in wide])
        at = np.searchsorted(where, inner)
        where, cost = np.insert(where, at, inner), np.insert(cost, at, INNER_COST)
    return where, cost


def cheapest_cuts(where: np.ndarray, cost: np.ndarray, limit: int = LIMIT, last: bool = True) -> list[int]:
    """Ends of the sequences that cover the stream up to the last place; with last=False, without the final, still open one.

    limit: a power of two. where: ascending places above 0 with gaps of at most `limit`; cost: their penalties. Ties go to the longer sequence.
    """
    spots = np.concatenate(([0], where))
    index = np.full(int(spots[-1]) + 1, -1)
    index[spots] = np.arange(len(spots))
    exact: dict[int, list[int]] = {}
    for p in (p for p in POWERS if p <= limit):
        k = np.where(spots >= p, index[np.maximum(spots - p, 0)], -1)
        for j, i in zip(np.flatnonzero(k >= 0).tolist(), k[k >= 0].tolist()):
            exact.setdefault(j, []).append(i)
    x, c = spots.tolist(), [0.0, *cost.tolist()]
    best, back = [0.0] * len(x), [0] * len(x)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(x)):
        end = x[j]
        while x[queue[0][1]] < end - limit:
            queue.popleft()
        key, i = queue[0]
        low = key + limit - end
        if j in exact:
            for k in exact[j]:
                if best[k] < low:
                    low, i = best[k], k
        best[j] = low = low + c[j] + SEQUENCE_COST
        back[j] = i
        key = low + end
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    j = len(x) - 1
    if not last:  # end at the cheapest place of the last window
        from_ = int(np.searchsorted(spots, spots[-1] - limit))
        j = min(range(from_, len(x)), key=lambda k: best[k] + x[k] * 1e-9)
    out = []
    while j > 0:
        out.append(x[j])
        j = back[j]
    return out[::-1]


class _Packer:
    """The stream of one partition: takes documents, gives pieces of full sequences."""

    def __init__(self, first_sequence: int, limit: int):
        self.limit, self.sequence = limit, first_sequence
        self.docs: list[tuple[int, int, int, int, bytes]] = []  # row, stream start, first token, all tokens, ids from there
        self.where: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.length = 0

    def add(self, row: int, ids: bytes, sentences: np.ndarray) -> None:
        n = len(ids) // 4
        where, cost = places(n, sentences)
        self.docs.append((row, self.length, 0, n, ids))
        self.where.append(where + self.length)
        self.cost.append(cost)
        self.length += n

    def flush(self, last: bool) -> Iterator[tuple]:
        """(row, start, length, crc32, doc_tokens, sequence, offset) of the sequences that are settled; the rest is kept."""
        if not self.length:
            return
        where, cost = np.concatenate(self.where), np.concatenate(self.cost)
        cuts = cheapest_cuts(where, cost, self.limit, last)
        d = begin = 0
        for end in cuts:
            at = begin
            while at < end:
                row, base, first, total, ids = self.docs[d]
                a, b = at - base, min(end - base, len(ids) // 4)
                yield row, first + a, b - a, zlib.crc32(ids[4 * a : 4 * b]), total, self.sequence, at - begin
                at = base + b
                if b == len(ids) // 4:
                    d += 1
            self.sequence += 1
            begin = end
        rest = []
        for row, base, first, total, ids in self.docs[d:]:
            a = max(begin - base, 0)
            rest.append((row, base + a - begin, first + a, total, ids[4 * a :]))
        self.docs, self.length = rest, self.length - begin
        keep = where > begin
        self.where, self.cost = [where[keep] - begin], [cost[keep]]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text with END after them; null and empty texts are END alone. Each id lies in one
    piece, sequences hold at most `limit` ids, and offsets in a sequence run from 0 without a gap. The order is that of
    the rows in each partition of docs; nothing is shuffled, and a partition's last sequences are cut into powers of two
    where that saves padding. sequence_id is the partition's number times 2**33 plus the sequence's number there. Repeated
    rows and ids are packed as often as they occur; a null id is an id. Very long texts are cut into as many pieces as they need; an
    empty table gives an empty one. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__t"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([src.schema[0], *[T.StructField(n, T.LongType()) for n in names]])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        packer = _Packer(TaskContext.get().partitionId() << 33, limit)
        end = np.array([END], "<u4").tobytes()
        ids: dict[int, object] = {}
        rows = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            pieces = list(packer.flush(last))
            if pieces:
                row, *rest = zip(*pieces)
                columns = [pa.array([ids[r] for r in row], kinds[0]), *[pa.array(v, k) for v, k in zip(rest, kinds[1:])]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            live = {d[0] for d in packer.docs}
            for r in [r for r in ids if r not in live]:
                del ids[r]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, (tokens, sentences) in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids[rows] = key
                    packer.add(rows, tokens + end, sentences)
                    rows += 1
                    if packer.length >= block:
                        yield from out(False)
        yield from out(True)

    return src.mapInArrow(run, schema)
