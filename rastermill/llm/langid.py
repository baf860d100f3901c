"""Language identification by bit-sliced Bloom filters of n-grams.

One table of language bitmasks stands for a Bloom filter per language: bit L of a slot is that slot of L's filter. The
AND of an n-gram's slots gives all languages that contain it in one go. A text's n-grams are looked up, the set bits
are counted for each language, the counts are corrected by the rate at which that language's filter answers yes by
mistake, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, crc_rest, map_text

#: Slots (a power of two), slots looked up for an n-gram, documents and n-grams per language that filters are made of.
SLOTS, PROBES, SAMPLE_DOCS, GRAMS = 1 << 20, 3, 8000, 30_000
#: An n-gram belongs to a language if its share of that language's n-grams is so large a part of its largest share.
LEAST_PART = 0.05
#: An n-gram that only one sampled document holds counts half in a language of so many sampled documents, and less in one of more.
FEW_DOCS = 50
#: Characters handled at once.
BLOCK = 1 << 17
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter (\\p{L})."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(pieces: list[tuple[int, str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the pieces' own letters, and their texts; a piece: (text, characters, first own one, own ones)."""
    edge = "\n\n\n"
    points = np.frombuffer((edge + edge.join(p[1] for p in pieces) + edge).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = 3 + np.cumsum([0, *[len(p[1]) + 3 for p in pieces[:-1]]])
    own = np.zeros(len(points), bool)
    for at, (_, _, lead, n) in zip(starts.tolist(), pieces):
        own[at + lead : at + lead + n] = True
    letter = _letters()[np.minimum(points, 0x10FFFF)]
    p = np.where(letter, points, 0).astype(np.uint64)
    at = np.flatnonzero(letter & own)
    owner = np.array([q[0] for q in pieces], np.int64)[np.searchsorted(starts, at, "right") - 1]
    p0, p1, p2 = p[at - 1], p[at], p[at + 1]
    before = np.where(p0 > 0, p[at - 2], 0)
    with np.errstate(over="ignore"):
        three = (p0 << np.uint64(42)) | (p1 << np.uint64(21)) | p2
        four = _mix(three + np.uint64(1)) + before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1 << 63)
    return np.concatenate((_mix(three), _mix(four))), np.concatenate((owner, owner))


def gram_blocks(texts: list[bytes | None], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all n-grams, with the text that each is from, for about `block` characters at a time.

    The n-grams: for each letter of a word, in lower case, the letter with its neighbours, and with the two before it and the
    one after; a word's edge counts as one more letter. A text longer than a block comes in several, which overlap by
    those neighbours, so that each n-gram comes once.
    """
    held, size = [], 0
    for r, t in enumerate(texts):
        s = (t or b"").decode("utf-8", "replace").lower()
        for a in range(0, len(s), block):
            held.append((r, s[max(a - 2, 0) : a + block + 1], min(a, 2), min(block, len(s) - a)))
            size += len(held[-1][1])
            if size >= block:
                yield _grams(held)
                held, size = [], 0
    if held:
        yield _grams(held)


def gram_counts(texts: list[bytes | None], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct n-grams of each text, by text and hash."""
    owners, hashes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for blocks in (gram_blocks(texts, block), None):  # within blocks, then over those that a text had several of
        for h, owner, n in ((h, o, np.ones(len(h), np.int64)) for h, o in blocks) if blocks else [(np.concatenate(hashes), np.concatenate(owners), np.concatenate(counts))]:
            order = np.lexsort((h, owner))
            h, owner, n = h[order], owner[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))) if len(h) else np.zeros(0, int)
            merged = owner[new], h[new], np.add.reduceat(n, new) if len(new) else n
            owners.append(merged[0])
            hashes.append(merged[1])
            counts.append(merged[2])
    return merged


@dataclass
class LanguageFilters:
    langs: list[str]
    planes: list[np.ndarray]  # 64 languages each
    false_rate: np.ndarray
    common: int = 0

    @staticmethod
    def slots(h: np.ndarray) -> list[np.ndarray]:
        bits = SLOTS.bit_length() - 1
        return [((h >> np.uint64(k * bits)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(PROBES)]

    @classmethod
    def build(cls, grams_of: dict[str, np.ndarray], common: str | None) -> LanguageFilters:
        langs = sorted(grams_of)
        planes = [np.zeros(SLOTS, np.uint64) for _ in range((len(langs) + 63) // 64)]
        rate = np.zeros(len(langs))
        for k, lang in enumerate(langs):
            mine = np.zeros(SLOTS, bool)
            for s in cls.slots(grams_of[lang]):
                mine[s] = True
            planes[k // 64][mine] |= np.uint64(1 << (k % 64))
            rate[k] = mine.mean() ** PROBES
        return cls(langs, planes, rate, langs.index(common) if common in langs else 0)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        n, m = len(texts), len(self.langs)
        total, counts = np.zeros(n), np.zeros((n, m))
        for h, owner in gram_blocks(texts):
            total += np.bincount(owner, minlength=n)
            places = self.slots(h)
            for q, plane in enumerate(self.planes):
                mask = plane[places[0]]
                for s in places[1:]:
                    mask &= plane[s]
                for k in range(64 * q, min(64 * q + 64, m)):
                    counts[:, k] += np.bincount(owner, ((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(float), n)
        share = counts / np.maximum(total, 1)[:, None]
        share = np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1) if m else share
        best = np.where(share.max(axis=1) > 0, share.argmax(axis=1), self.common) if m else np.zeros(n, int)
        sure = share.max(axis=1) ** 2 / np.maximum(share.sum(axis=1), 1e-12) if m else np.zeros(n)
        return [self.langs[b] if t and m else UNKNOWN for b, t in zip(best, total)], [float(s) if t else 0.0 for s, t in zip(sure, total)]


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.coalesce(crc_rest(id_col, 4) == 2, F.lit(False))


def sample_bound(n: int, sample: int) -> int:
    """The bound of a 64-bit hash below which `sample` of n documents are expected; any n, in whole numbers."""
    return (1 << 63) - 1 if n <= sample else -(1 << 63) + (sample << 64) // n


def smallest_of_each(open_: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """`sample` rows of each language, those whose id has the smallest hash (more only where ids repeat).

    A first bound on the hash, with room to spare, leaves few ids to rank; the last one ranked is the bound that texts are held against,
    so that no text is shuffled.
    """
    session, u = open_.sparkSession, F.xxhash64("__id", F.lit("lang"))
    first = session.createDataFrame([(k, sample_bound(n, sample + 6 * int(sample**0.5) + 6)) for k, n in sizes.items()], "of string, bound long")
    within = lambda df, bounds: df.join(bounds, F.col("__lang") == F.col("of")).where(u <= F.col("bound")).drop("of", "bound")
    ids = within(open_.select("__id", "__lang"), first).select("__lang", u.alias("u"))
    nth = F.row_number().over(Window.partitionBy("__lang").orderBy("u"))
    last = checkpoint(ids.withColumn("nth", nth).where(F.col("nth") <= sample).groupBy(F.col("__lang").alias("of")).agg(F.max("u").alias("bound")))
    return within(open_, last)


def sure_part(docs: int) -> float:
    """What an n-gram of a single document counts where a language has so many sampled documents: all of it for one, half of it for FEW_DOCS, then ever less."""
    return 1 / (1 + ((docs - 1) / FEW_DOCS) ** 2)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS, most: int = GRAMS) -> LanguageFilters:
    """Filters from `sample` documents for each language, with a non-null language and not held out.

    The documents of a language are those whose id has the smallest hash. Their n-grams are counted by Spark; of each
    language at most `most` come to the driver, the most frequent ones first, hash order on ties; rarer ones are in no
    filter, which lowers all shares of a text alike. An n-gram of a single document counts the less the more documents of its language
    were sampled (sure_part). The driver holds a row for each language.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__t"))
    open_ = own.where(F.col("__lang").isNotNull() & F.col("__t").isNotNull() & ~held_out("__id"))
    sizes = {r[0]: r[1] for r in open_.groupBy("__lang").count().collect()}
    if not sizes:
        return LanguageFilters([], [], np.zeros(0))
    some = smallest_of_each(open_, sizes, sample)

    def make():
        def run(texts):
            owner, h, n = gram_counts(texts)
            return owner, [h.view(np.int64), n]

        return run

    counted = map_text(some, make, [T.StructField("h", T.LongType()), T.StructField("n", T.LongType())], ["__lang"], "__t", explode=True).groupBy("__lang", "h").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    counted = checkpoint(counted)
    totals = {r[0]: r[1] for r in counted.groupBy("__lang").agg(F.sum("n")).collect()}
    found = {k: np.zeros(0, np.uint64) for k in sizes}
    if totals:
        weights = open_.sparkSession.createDataFrame([(k, sure_part(min(sizes[k], sample)), n) for k, n in totals.items()], "lang string, once double, total long").withColumnRenamed("lang", "of")
        held = counted.join(weights, F.col("__lang") == F.col("of"))  # a small table: Spark sends it or shuffles, as it sees fit
        # an n-gram of one document alone is worth the less the more documents could have had it
        shares = held.select("__lang", "h", (F.col("n") / F.col("total") * F.when(F.col("docs") > 1, 1.0).otherwise(F.col("once"))).alias("share")).where("share > 0")
        by_gram = shares.groupBy("h").agg(F.max("share").alias("top"), F.collect_list(F.struct("__lang", "share")).alias("of"))  # one entry for each language
        mine = checkpoint(by_gram.select("h", "top", F.explode("of").alias("x")).where(F.col("x.share") >= LEAST_PART * F.col("top")).select("h", F.col("x.__lang").alias("lang"), F.col("x.share").alias("share")))
        best = Window.partitionBy("lang").orderBy(F.desc("share"), "h")
        kept = mine.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("lang", "h").collect()
        for lang in totals:
            found[lang] = np.array([r[1] for r in kept if r[0] == lang], np.int64).view(np.uint64)
    return LanguageFilters.build(found, min(sizes, key=lambda k: (-sizes[k], k)))


def identify(docs: DataFrame, filters: LanguageFilters, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep with lang_pred and score (0 to 1: the share of the text's n-grams that the language
    has, times its part of all languages' shares).

    A null text and one with no letter give `und` and 0; a text whose n-grams no language has gives the most frequent
    language and 0; ties go to the first language by name. Whole texts count, row by row, a block of characters at a time;
    an empty table gives an empty one, repeated rows get equal results; columns of keep that have the
    name of a result are replaced.
    """

    def make():
        return lambda texts: list(filters.predict(texts))

    return map_text(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep, text_col)
