"""SimHash near-duplicates: 64-bit fingerprints, linked by a byte-position index with count filtering.

Two fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they share at least
four positional bytes. Postings of single bytes would each hold 1/256 of all fingerprints, and pairs within them would
grow with the square of the input; the index therefore posts each fingerprint under triples of positional bytes. The
20 triples of TRIPLES are such that any four shared positions contain one of them, so that no pair that reaches the
minimum is lost. Postings that are still long are split by a fourth shared byte. For a pair that meets, the shared
positional bytes are tallied, pairs below the minimum go, and the bits of the rest are counted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, by_position, checkpoint, map_text, shuffles_removed
from .graph import connected_components
from .minhash import components
from .shingles import fingerprint, hashes

BITS, WIDTH = 4, 4
#: Postings longer than this are split by a fourth byte.
LONG_POSTING = 128


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of 0..7 such that each four of 0..7 hold one: all of a part, or two of a part and one of the next."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for p in parts for t in combinations(p, 3)]
    for k, p in enumerate(parts):
        out += [(*two, one) for two in combinations(p, 2) for one in parts[(k + 1) % 3]]
    return sorted(tuple(sorted(t)) for t in out)


TRIPLES = covering_triples()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id_col, fp) for each row, fp being the fingerprint's 64 bits as a long. Null and wordless texts: 0."""

    def make():
        return lambda texts: [np.array([fingerprint(hashes(t, width)) for t in texts], np.uint64).view(np.int64)]

    return map_text(docs, make, [T.StructField("fp", T.LongType())], [id_col], text_col)


def _byte(c: Column, j: int) -> Column:
    return F.shiftrightunsigned(c, 56 - 8 * j).bitwiseAND(F.lit(255))


def _lookups() -> tuple[list[int], list[int]]:
    """For each set of shared positions (bit j: position j): its first triple, and the first shared position outside it."""
    first, extra = [], []
    for mask in range(256):
        has = {j for j in range(8) if mask >> j & 1}
        t = next((k for k, t in enumerate(TRIPLES) if has >= {*t}), -1)
        first.append(t)
        extra.append(min(has - {*TRIPLES[t]}, default=-1) if t >= 0 else -1)
    return first, extra


def links(fps: DataFrame, bits: int = BITS, long_posting: int = LONG_POSTING) -> DataFrame:
    """(a, b), a < b, for each pair of distinct fingerprints (column fp, no repeats) that differ in 1 to `bits` bits, once."""
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees shared bytes for at most four differing bits")
    fp = F.col("fp")
    postings = fps.select("fp", F.explode(F.array(*[F.lit(k << 24).cast("long") + _byte(fp, x) * 65536 + _byte(fp, y) * 256 + _byte(fp, z) for k, (x, y, z) in enumerate(TRIPLES)])).alias("key"))
    long = postings.groupBy("key").count().where(F.col("count") > long_posting).select("key", F.lit(True).alias("long"))
    outside = F.array(*[F.array(*[F.lit(j) for j in range(8) if j not in t]) for t in TRIPLES])
    rest = F.element_at(outside, (F.shiftright("key", 24) + 1).cast("int"))
    fourth = F.transform(rest, lambda j: j.cast("long") * 256 + F.element_at(F.array(*[_byte(fp, k) for k in range(8)]), j + 1))
    split = postings.join(long, "key", "left").select("fp", "key", F.explode(F.when(F.col("long"), fourth).otherwise(F.array(F.lit(-1).cast("long")))).alias("more"))
    split = split.select("fp", "key", "more")
    one, two = split.alias("one"), split.alias("two")  # the same columns on both sides, so that the postings are shuffled once
    a, b = F.col("one.fp"), F.col("two.fp")
    differ = a.bitwiseXOR(b)
    shared = sum((F.when(_byte(differ, j) == 0, 1 << j).otherwise(0) for j in range(8)), F.lit(0))
    first, extra = _lookups()
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), shared + 1)
    enough = F.bit_count(shared) >= 8 - bits
    once = (at(first) == F.shiftright("one.key", 24)) & ((F.col("one.more") < 0) | (at(extra) == F.shiftright("one.more", 8)))
    met = (F.col("one.key") == F.col("two.key")) & (F.col("one.more") == F.col("two.more")) & (a < b)
    return one.join(two, met & enough & (F.bit_count(differ) <= bits) & once).select(a.alias("a"), b.alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id_col, fp, component_id) for each row: component_id is the smallest id reachable over links of fingerprints.

    Texts are lower-cased (A-Z), split into words at space and U+0009..U+000D, and hashed as 4-word shingles (XXH64, seed
    42); shorter texts are one shingle; null and wordless texts have fingerprint 0 and are linked like any other. Equal
    fingerprints are one class, so copies cost nothing beyond their row. Rows with a null id get their component's
    smallest id, null if all its ids are null. Repeated ids are separate rows. Very long texts count whole; an empty table gives an
    empty one. Other columns are left out, whatever their names.
    """
    held = checkpoint(fingerprints(docs, id_col, text_col))
    classes = held.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(links(classes.select("fp"), bits))
    linked = roots.withColumnRenamed("node", "fp").join(classes, "fp")
    best = checkpoint(linked.groupBy("root").agg(F.min("least").alias("best")))  # apart from the join below, whose large components can then be split
    named = classes.join(linked.join(best, "root").select("fp", "best"), "fp", "left").select("fp", F.when(F.col("best").isNull(), F.col("least")).otherwise(F.col("best")).alias("component_id"))
    return held.join(named, "fp").select(id_col, "fp", "component_id")


def near_candidates(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of classes (cid, n, fp) that the index finds: each class with the least of its fingerprint, and those of linked fingerprints."""
    worded = classes.where("n > 0")
    of = checkpoint(worded.groupBy("fp").agg(F.min("cid").alias("a")))
    same = worded.join(of, "fp").where("cid <> a").select("a", F.col("cid").alias("b"))
    pairs = links(of.select("fp"), bits).toDF("fa", "fb")
    linked = pairs.join(of.toDF("fa", "x"), "fa").join(of.toDF("fb", "y"), "fb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(linked)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of docs, with all columns, that stay when one row of each group of near copies does (five-word shingles, similarity 0.8 or more): that of the smallest id.

    Fingerprints within BITS bits are candidates, found by the index. As most pairs of similarity 0.8 lie beyond any number of
    bits that shared bytes can promise, pairs that meet in MinHash buckets are candidates besides, which lose a pair at the limit with
    a probability of under 1e-9. All are confirmed by their whole sets (minhash.links).

    Words as of shingles.hashes. Null and wordless texts are one component. Rows are told apart by id and text: of unlike
    texts that share an id each counts for itself, and on ties the smaller hash of the text stays; of rows that repeat
    both, one stays, that of the smaller hash of its columns. Rows with a null id stay. Very long texts count whole. An
    empty table gives an empty one; no column's name clashes with a working column.
    """
    own, (i, t) = by_position(docs, id_col, text_col)
    with shuffles_removed(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        own = own.withColumns({"th": F.xxhash64(F.col(t).cast("string")), "id": F.col(i)})
        known = own.where(F.col("id").isNotNull()).select("id", "th", F.col(t).cast("string").alias("said"))
        held, named = components(known, width, scratch, near_candidates)
        named = scratch.put(named)
        best = scratch.put(named.groupBy("root").agg(F.min("least").alias("best")))
        rows = held.groupBy("id", "th").agg(F.min(F.struct("k1", "k2")).alias("k"), F.count("*").alias("rows")).select("id", "th", "rows", "k.k1", "k.k2")
        judged = rows.join(named.select("k1", "k2", "root").join(best, "root"), ["k1", "k2"]).select("id", "th", (F.struct("id", "th") == F.col("best")).alias("stays"), "rows")
        judged = checkpoint(judged.where("not stays or rows > 1"))
    out = own.join(judged.select("id", "th"), ["id", "th"], "left_anti")
    if judged.where("stays").isEmpty():  # no row repeats both id and text: the texts are shuffled once
        return out.drop("id", "th").toDF(*docs.columns)
    repeated = own.join(judged.where("stays").select("id", "th"), ["id", "th"], "left_semi")
    order = F.xxhash64(*[F.to_json(F.struct(c)) for c in own.columns if c not in ("id", "th")])
    once = repeated.withColumn("nth", F.row_number().over(Window.partitionBy("id", "th").orderBy(order))).where("nth = 1").drop("nth")
    return out.unionByName(once).drop("id", "th").toDF(*docs.columns)
