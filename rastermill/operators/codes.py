"""Codebooks, codes as strings of bits, and how often each code is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KC, K


def codebook(res: DataFrame, bits: int, mode: str = "Stable_Uniform", seed: int = 0) -> DataFrame:
    """(image_id, channel, book): up to 2**bits whole numbers over the range of the differences.

    Uniform: evenly spaced, both ends among them, floored. Stable_Uniform: the same, but where no entry is within 1 of zero
    the first of the largest magnitude gives way to 0. Random: distinct numbers below the upper end, those of the smallest
    hash. A range of one or less gives its lower end; one below 2**bits gives all its numbers but the upper end.
    """
    n = 1 << bits
    ends = res.groupBy(*KC).agg(F.min("diff").alias("lo"), F.max("diff").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    every = F.sequence(lo, hi - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor((lo * (n - 1) + i * (hi - lo)) / F.lit(n - 1)).cast("int")) if bits else F.array(lo)
    if mode == "Random":
        full = F.array_sort(F.transform(F.slice(F.array_sort(F.transform(every, lambda v: F.struct(F.xxhash64(v, *KC, F.lit(seed)).alias("h"), v.alias("v")))), 1, n), lambda x: x["v"]))
    elif mode == "Uniform":
        full = spread
    else:
        farthest = F.array_max(F.transform(spread, lambda v: F.struct(F.abs(v).alias("d"), (-v).alias("v"))))["v"] * -1  # the lower of two equally far
        none_near = ~F.exists(spread, lambda v: F.abs(v) <= 1)
        full = F.when(none_near, F.array_sort(F.concat(F.array_remove(spread, farthest), F.array(F.lit(0))))).otherwise(spread)
    return ends.select(*KC, F.when(lo + 1 >= hi, F.array(lo)).when(hi - lo < n, every).otherwise(full).alias("book"))


def _bits(code: Column, width: int, signed: bool) -> Column:
    size = F.lpad(F.bin(F.abs(code)), width - signed, "0")
    return F.concat(F.when(code >= 0, "1").otherwise("0"), size) if signed else size


def pack_codes(df: DataFrame, keys: list[str], order: list[str], code: str, width: int, signed: bool = False) -> DataFrame:
    """(keys, bits, pad, overflow): each group's codes at a fixed width in `order`, with zeros to whole bytes.

    Unsigned codes are plain binary; signed ones lead with a bit, 1 for numbers that are not negative. overflow tells
    that a code of the group doesn't fit, and its bits are then not to be used. A group's codes must fit in a row.
    """
    c = F.col(code)
    over = (F.length(F.bin(F.abs(c))) > width - signed) | (F.lit(not signed) & (c < 0))
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, _bits(c, width, signed).alias("b")))).alias("v"), F.max(over).alias("overflow"))
    text = F.array_join(F.transform("v", lambda x: x["b"]), "")
    pad = F.pmod(-F.length(F.col("bits")), F.lit(8))
    out = packed.select(*keys, text.alias("bits"), "overflow").withColumn("pad", pad)
    return out.select(*keys, F.concat("bits", F.repeat(F.lit("0"), F.col("pad"))).alias("bits"), "pad", "overflow")


def unpack_codes(packed: DataFrame, keys: list[str], width: int, signed: bool = False) -> DataFrame:
    """(keys, pos, code): the inverse of pack_codes."""
    n = F.floor((F.length("bits") - F.col("pad")) / width).cast("int")
    some = packed.where(n > 0).select(*keys, "bits", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    part = some.select(*keys, "pos", F.expr(f"substring(bits, pos * {width} + 1, {width})").alias("b"))
    value = F.conv(F.substring("b", 2, width) if signed else F.col("b"), 2, 10).cast("int")
    return part.select(*keys, "pos", (F.when(F.substring("b", 1, 1) == "1", value).otherwise(-value) if signed else value).alias("code"))


def encode_float(c: Column, decimals: int = 4) -> Column:
    """A number as the whole number of its `decimals` places, truncated towards zero."""
    return (c * 10**decimals).cast("long")


def decode_float(c: Column, decimals: int = 4) -> Column:
    """The number that encode_float made a whole number of, to its `decimals` places."""
    return c.cast("double") / 10**decimals


def code_histogram(codes: DataFrame, code: str, width: int) -> DataFrame:
    """(image_id, code, n, bits): use of each code, and the bits spent on it."""
    return codes.groupBy("image_id", F.col(code).alias("code")).agg(F.count("*").alias("n")).withColumn("bits", F.col("n") * width)


def prefix_lengths(histogram: DataFrame, code: str = "code", count: str = "n", keys: list[str] | None = None) -> DataFrame:
    """(keys, code, n, length, word): lengths of an optimal prefix code of each image's codes, from a histogram, and its canonical words.

    The two lightest groups of codes become one until one is left, each time all their codes get one bit more; ties by the lowest code.
    It is a fold over the codebook, which bounds it, in array expressions: an image is one row, and images spread over tasks. A lone code
    has one bit. Words are numbered by length, then code.
    """
    keys = keys or K
    groups = F.array_sort(F.collect_list(F.struct(F.col(count).cast("long").alias("w"), F.col(code).cast("long").alias("least"), F.array(F.col(code).cast("long")).alias("codes"))))
    held = histogram.groupBy(*keys).agg(groups.alias("groups"), F.map_from_entries(F.collect_list(F.struct(F.col(code).cast("long"), F.col(count).cast("long")))).alias("count"))
    start = F.struct(F.col("groups").alias("g"), F.transform(F.map_keys("count"), lambda c: F.struct(c.alias("code"), F.lit(0).alias("length"))).alias("lengths"))

    def merged(state, _):
        a, b = F.get(state["g"], F.lit(0)), F.get(state["g"], F.lit(1))
        codes = F.concat(a["codes"], b["codes"])
        one = F.struct((a["w"] + b["w"]).alias("w"), F.least(a["least"], b["least"]).alias("least"), codes.alias("codes"))
        rest = F.slice(state["g"], F.lit(3), F.greatest(F.size(state["g"]) - 2, F.lit(0)))
        longer = F.transform(state["lengths"], lambda x: F.struct(x["code"].alias("code"), (x["length"] + F.array_contains(codes, x["code"]).cast("int")).alias("length")))
        return F.when(F.size(state["g"]) < 2, state).otherwise(F.struct(F.array_sort(F.concat(rest, F.array(one))).alias("g"), longer.alias("lengths")))

    done = held.select(*keys, "count", F.aggregate(F.sequence(F.lit(1), F.size("groups")), start, merged)["lengths"].alias("lengths"))
    each = done.select(*keys, "count", F.inline("lengths")).select(*keys, F.col("code").alias(code), F.element_at("count", F.col("code")).alias(count), F.greatest(F.lit(1), "length").alias("length"))
    order = Window.partitionBy(*keys).orderBy("length", code).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("length"))).over(order), F.lit(0.0))  # exact: sums of powers of two
    word = F.lpad(F.bin((before * F.pow(F.lit(2.0), F.col("length"))).cast("long")), F.col("length"), "0")
    return each.withColumn("word", word)


def coded_size(histogram: DataFrame, width: int, code: str = "code", count: str = "n") -> DataFrame:
    """(image_id, codes, fixed_bits, coded_bits, entropy_bits): an image's codes at `width` bits each, by its prefix code, and the bound that no code beats."""
    lengths = prefix_lengths(histogram, code, count)
    n = F.col(count)
    sums = lengths.groupBy(*K).agg(F.sum(n).alias("codes"), F.sum(n * F.col("length")).alias("coded_bits"), F.sum(n * F.log2(n)).alias("part"))
    return sums.select(*K, "codes", (F.col("codes") * width).alias("fixed_bits"), "coded_bits", F.round(F.col("codes") * F.log2("codes") - F.col("part"), 3).alias("entropy_bits"))
