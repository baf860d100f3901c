"""MinHash near-duplicates: texts whose sets of word shingles have a Jaccard similarity of 80 % or more, linked into components.

Signatures are circulant: shingles fall on 2^32 places, one permutation shuffles the places, and a second one, shifted round by one more
place for each coordinate, is read at its least value. BANDS bands of ROWS coordinates are the buckets. A pair of similarity s
meets in none of them with a probability of (1 - s^ROWS)^BANDS: under 1e-9 at the limit of 0.8, under 1e-13 at 0.85. That pair's
link only counts where no other path joins the two. Every link is confirmed by the whole sets.

A bucket of g sets has g * g pairs, but its components need fewer. Equal sets are one class. In each bucket the class that
meets most others is the pivot, which finds the text that a group was copied from; each class is compared with the pivot that it
shares most buckets with. Only classes of a bucket that are then of different components are met pair by pair, under two bounds that
hold for every similar pair: their sizes, and the bits in which two odd sketches differ, which are no more than the shingles that
only one of them has. Sets of over some two thousand shingles fill the sketch, so that sizes alone bound them.

What is shuffled: buckets (16 bytes a band and class), and the texts of pairs that pass the bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, by_position, checkpoint, map_text, shuffles_removed
from .graph import connected_components
from .shingles import fingerprint, hashes

WIDTH, PERCENT = 4, 80
ROWS, BANDS = 4, 40
#: Longs of an odd sketch.
ODD = 16
#: Shingles whose coordinates are worked out at once.
BLOCK = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(hashes(text, width))


def _shifted(places: np.ndarray, k: int, t: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Values of the second permutation, shifted by k, at places: an invertible mix of 32 bits. t and u are room of the same size."""
    np.add(places, np.uint32(k), out=t)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(t, np.uint32(shift), out=u)
        np.bitwise_xor(t, u, out=t)
        if factor:
            np.multiply(t, np.uint32(factor), out=t)
    return t


def coordinates(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(len(sets), count) signature coordinates of sets of hashes; those of an empty set are all ones."""
    out = np.full((count, len(sets)), np.iinfo(np.uint32).max, np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[k] for k in full])
        places = ((joined ^ (joined >> np.uint64(29))) * _MIX >> np.uint64(32)).astype(np.uint32)  # the first permutation
        owner = np.repeat(np.array(full), [len(sets[k]) for k in full])
        t, u = np.empty(BLOCK, np.uint32), np.empty(BLOCK, np.uint32)
        for at in range(0, len(places), BLOCK):
            part, own = places[at : at + BLOCK], owner[at : at + BLOCK]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            whose = own[starts]
            for k in range(count):
                least = np.minimum.reduceat(_shifted(part, k, t[: len(part)], u[: len(part)]), starts)
                out[k, whose] = np.minimum(out[k, whose], least)
    return out.T


def bands(coords: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) hashes of `rows` coordinates each, with the band's number."""
    parts = coords.reshape(len(coords), -1, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _MIX, parts.shape[:2]).copy()
    for r in range(rows):
        h = (h ^ parts[:, :, r]) * _MIX
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def odd_sketch(s: np.ndarray, longs: int = ODD) -> np.ndarray:
    """A bit tells whether the set has an odd number of the hashes that fall on it."""
    bits = 64 * longs
    return np.packbits((np.bincount(((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _measured(known: DataFrame, width: int, simhash: bool) -> DataFrame:
    """(id, th, k1, k2, n, fp, sig): 128 bits that stand for the set, its size, the SimHash of the shingles, and the set's odd sketch and bands; a task gives sig once for each set."""

    def make():
        seen = set()

        def run(texts):
            every = [hashes(t, width) for t in texts]
            prints = np.array([fingerprint(h) if simhash else 0 for h in every], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in every]
            keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            new = [k for k in range(len(sets)) if len(sets[k]) and keys[k] not in seen and not seen.add(keys[k])]
            sig = [np.zeros(0, np.int64)] * len(sets)
            if new:
                for k, b in zip(new, bands(coordinates([sets[k] for k in new], ROWS * BANDS), ROWS)):
                    sig[k] = np.concatenate((odd_sketch(sets[k]), b))
            half = lambda x: x - (1 << 64) if x >> 63 else x
            return [[half(k >> 64) for k in keys], [half(k & (1 << 64) - 1) for k in keys], [len(s) for s in sets], prints, sig]

        return run

    long = T.LongType()
    return map_text(known, make, [T.StructField("k1", long), T.StructField("k2", long), T.StructField("n", long), T.StructField("fp", long), T.StructField("sig", T.ArrayType(long))], ["id", "th"], "said")


def _alike(shared, m, n):
    """Whether sets of m and n shingles, of which `shared` are common, are similar enough; whole numbers or columns of them."""
    return (100 + PERCENT) * shared >= PERCENT * (m + n)


def _may_be_alike(a: str, b: str) -> Column:
    """For two classes with columns n<a>, o<a>0.. and n<b>, o<b>0..: neither bound rules their link out."""
    m, n = F.col(f"n{a}"), F.col(f"n{b}")
    differ = sum((F.bit_count(F.col(f"o{a}{k}").bitwiseXOR(F.col(f"o{b}{k}"))) for k in range(ODD)), F.lit(0))
    return _alike(F.least(m, n), m, n) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (m + n))


def _near_texts(both: DataFrame, width: int) -> DataFrame:
    """(a, b) for the rows of (a, b, x, y) whose texts x and y are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, None  # rows of one a mostly follow each other
        for batch in batches:
            a, b, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k in range(len(a)):
                if held != a[k] or left is None:
                    held, left = a[k], shingle_set(batch.column(2)[k].as_py().encode(), width)
                right = shingle_set(batch.column(3)[k].as_py().encode(), width)
                if _alike(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right)):
                    out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in out], pa.int64()) for c in (a, b)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, classes: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough; texts of their first documents go to the pairs, b's to a's."""
    least = classes.select(F.col("cid").alias("c"), "least.id", "least.th")
    same = (F.col("id").eqNullSafe(F.col("i"))) & (F.col("th") == F.col("t"))
    texts = lambda keys, c: known.select(F.col("id").alias("i"), F.col("th").alias("t"), "said").join(keys.join(least, F.col(c) == F.col("c")), same).drop("c", "id", "th", "i", "t")
    right = texts(pairs.select("a", "b"), "b").withColumnRenamed("said", "y")
    left = texts(pairs.select(F.col("a").alias("aa")).distinct(), "aa").withColumnRenamed("said", "x")
    return _near_texts(right.join(left, F.col("a") == F.col("aa")), width).distinct()


def _sketched(rows: DataFrame, classes: DataFrame, c: str, name: str) -> DataFrame:
    """rows with size and odd sketch of the class in column c, as n<name> and o<name>0.. ."""
    own = classes.select(F.col("cid").alias(f"__{name}"), F.col("n").alias(f"n{name}"), *[F.get("sig", F.lit(k)).alias(f"o{name}{k}") for k in range(ODD)])
    return rows.join(own, F.col(c) == F.col(f"__{name}")).drop(f"__{name}")


def links(classes: DataFrame, known: DataFrame, scratch: Scratch, width: int = WIDTH, index: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) of classes (cid, n, fp, sig, least) that give the components of all similar pairs; known: (id, th, said), with the text of each
    class's least (id, th); index: pairs (a, b) of cid to look at besides."""
    bucket = F.explode(F.slice("sig", ODD + 1, BANDS)).alias("bucket")
    postings = classes.where(F.size("sig") > 0).select("cid", bucket).repartition("bucket")
    sizes = postings.groupBy("bucket").agg(F.count("*").alias("g")).where("g > 1")
    live = scratch.put(postings.join(sizes, "bucket"))
    weight = live.groupBy("cid").agg(F.sum("g").alias("w"))
    weighed = live.join(weight, "cid").repartition("bucket")
    pivots = weighed.groupBy("bucket").agg(F.max(F.struct("w", "cid")).alias("p")).select("bucket", F.col("p.cid").alias("a"))
    met = weighed.join(pivots, "bucket").where("cid <> a").select(F.col("cid").alias("b"), "a").repartition("b")
    best = met.groupBy("b", "a").count().groupBy("b").agg(F.max(F.struct("count", "a")).alias("m")).select("b", F.col("m.a").alias("a"))
    some = best.select("a", "b").union(index(classes).select("a", "b")).distinct() if index else best
    first = _sketched(_sketched(checkpoint(some), classes, "a", "x"), classes, "b", "y").where(_may_be_alike("x", "y")).select("a", "b")
    one = checkpoint(_confirmed(checkpoint(first), classes, known, width))
    roots = connected_components(one)
    named = live.select("bucket", "cid").join(roots, F.col("cid") == F.col("node"), "left").select("bucket", "cid", F.coalesce("root", "cid").alias("root"))
    parts = named.groupBy("bucket", "root").count()
    largest = parts.groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("size")).where("most.count < size").select(F.col("bucket").alias("k"), F.col("most.root").alias("top"))
    apart = named.join(largest, F.col("bucket") == F.col("k")).select("bucket", "cid", "root", (F.col("root") == F.col("top")).alias("main"))
    side = lambda name: _sketched(apart, classes, "cid", name).select("bucket", *[F.col(c).alias(f"{c}{name}") for c in ("cid", "root", "main")], f"n{name}", *[f"o{name}{k}" for k in range(ODD)])
    once = ~F.col("mainx") & (F.col("mainy") | (F.col("cidx") < F.col("cidy"))) & (F.col("rootx") != F.col("rooty"))
    x, y = side("x").where("not mainx"), side("y").withColumnRenamed("bucket", "bucket2")
    left = x.join(y, (F.col("bucket") == F.col("bucket2")) & once & _may_be_alike("x", "y"))
    pairs = checkpoint(left.select(F.least("cidx", "cidy").alias("a"), F.greatest("cidx", "cidy").alias("b")).distinct())
    two = _confirmed(pairs, classes, known, width)
    return checkpoint(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(two))


def components(known: DataFrame, width: int, scratch: Scratch, index: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(held, named) of the texts known (id, th, said): held (id, th, k1, k2, n) a row for each, named (k1, k2, least, first, root) a row for each distinct set.

    Rows with one root are a component; least is a set's smallest (id, th), first its smallest id. The empty set has no link. With an
    index, classes have their SimHash as fp.
    """
    held = scratch.put(_measured(known, width, index is not None))
    some = held.groupBy("k1", "k2").agg(F.min(F.struct("id", "th")).alias("least"), F.min("id").alias("first"), F.max("n").alias("n"), F.min("fp").alias("fp"), F.max("sig").alias("sig"))
    classes = scratch.put(some.withColumn("cid", F.monotonically_increasing_id()))
    roots = connected_components(links(classes, known, scratch, width, index))
    named = classes.select("k1", "k2", "cid", "least", "first").join(roots, F.col("cid") == F.col("node"), "left")
    return held.select("id", "th", "k1", "k2", "n"), named.select("k1", "k2", "least", "first", F.coalesce("root", "cid").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row: component_id is the smallest id reachable over links of similar sets, kept
    tells whether it is the row's own.

    Texts are lower-cased (A-Z) and split into words at space and U+0009..U+000D; the set holds their distinct shingles of
    `width` words (64-bit hashes), or the whole sequence where words are fewer. Equal sets are linked; null and wordless
    texts have an empty set and are linked with nothing. Rows with a null id get their component's smallest id, null if all are
    null, which counts as their own. Repeated ids are separate rows. Texts of any length count whole; an empty table gives an
    empty one. Other columns are left out, whatever their names.
    """
    own, (i, t) = by_position(docs, id_col, text_col)
    with shuffles_removed(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        known = own.select(F.col(i).alias("id"), F.xxhash64(F.col(t).cast("string")).alias("th"), F.col(t).cast("string").alias("said"))
        held, named = components(known, width, scratch)
        named = scratch.put(named)
        best = named.groupBy("root").agg(F.min("first").alias("component_id"))
        named = scratch.put(named.join(best, "root").select("k1", "k2", "component_id"))
        alone = held.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
        out = checkpoint(held.where("n > 0").select("id", "n", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n", "component_id").union(alone))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
