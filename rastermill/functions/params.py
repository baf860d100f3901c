"""Default parameters of an image, the size curve of its strokes, and the size of its encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steady(c: Column) -> Column:
    """Rounded to six places before it is floored, so that engines agree on the last bit."""
    return F.round(c, 6)


def auto_params(images: DataFrame) -> DataFrame:
    """images with every null parameter filled in.

    Columns: image_id, width, height, rate_init, thumbnail, and the nullable stroke_count, cutoff, softness, progress,
    size_start, size_end, warmup. Adds downsample_rate, the sizes in cells (size_start_px, size_end_px), warmup_strokes and
    cycle_start. Pure: a value filled in for one image never reaches another.
    """
    low, high = F.least("width", "height"), F.greatest("width", "height")
    n = F.col("stroke_count")
    df = images.withColumn("downsample_rate", F.when(low < 600, F.lit(1.0)).otherwise(_steady(low / 500)))
    df = df.withColumn("stroke_count", F.coalesce(n, F.floor(20000 + F.lit(0.0015) * (high + 3200) * (high + 3200))).cast("long"))
    coarse = F.col("thumbnail") & (F.col("rate_init") < 32)
    both = F.col("size_start").isNull() & F.col("size_end").isNull()
    many = n > 20000
    df = df.withColumns({
        "cutoff": F.when(F.col("cutoff").isNull() & coarse, F.when(many, 0.3).otherwise(0.7)).otherwise(F.col("cutoff")),
        "warmup": F.when(F.col("warmup").isNull() & coarse, F.when(many, 0.1).otherwise(0.7)).otherwise(F.col("warmup")),
        "size_start": F.when(both & coarse, F.when(many, 0.05).otherwise(0.1)).otherwise(F.col("size_start")),
        "size_end": F.when(both & coarse, F.when(many, 0.01).otherwise(0.03)).otherwise(F.col("size_end")),
    })
    df = df.withColumns({
        "size_start": F.coalesce("size_start", _steady(0.3 + F.pow(F.lit(1 / 1.00095), n + 7000))),
        "size_end": F.coalesce("size_end", _steady(0.01 + F.pow(F.lit(1 / 1.00015), n + 10200))),
        "warmup": F.coalesce("warmup", _steady(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.75 - F.lit(1.4e-5) * (n - 1000) * (n - 1000) / 550000)))),
        "cutoff": F.coalesce("cutoff", F.round(0.01 + F.pow(F.lit(1 / 1.0000115), n + 15000), 4)),
        "softness": F.coalesce("softness", F.lit(0.5)),
        "progress": F.coalesce("progress", F.lit(0.5)),
    })
    cells = lambda share: (F.floor(_steady(F.col(share) * (low - 2))) + 2).cast("int")
    return df.withColumns({"size_start_px": cells("size_start"), "size_end_px": cells("size_end"), "warmup_strokes": F.floor(_steady(F.col("warmup") * n)).cast("long"), "cycle_start": F.floor(_steady(n * 0.9)).cast("long")})


def decay_sizes(params: DataFrame) -> DataFrame:
    """(image_id, stroke_id, size): the size of each stroke, a row becoming stroke_count rows.

    params: image_id, stroke_count, start, end (cells), cutoff, softness, progress. A cutoff of 0 or less gives the end size
    throughout, 3 or more the start size, both as they are; any other size is made even. The last three count to four places.
    """
    n, s, e, cut, soft, prog = *(F.col(c) for c in ("stroke_count", "start", "end")), *(F.round(F.col(c), 4) for c in ("cutoff", "softness", "progress"))
    df = params.select("*", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("stroke_id"))
    i = F.col("stroke_id")
    x = F.when(n > 1, i * n / (n - 1)).otherwise(F.lit(0.0))
    stop = n * cut
    straight = s + x / stop * (e - s)
    steepness = F.lit(1.0) / soft * (F.sqrt(F.abs(e - s)) / n)
    step = F.when(soft <= 0, F.when(x >= stop / 2, e).otherwise(s).cast("double")).otherwise(s + (e - s) / (1 + F.exp(-steepness * (x - stop / 2))))
    mixed = F.when(x >= stop, e.cast("double")).otherwise(prog * step + (1 - prog) * straight)
    even = F.floor(_steady(mixed) / 2) * 2
    return df.select("image_id", "stroke_id", F.when(cut <= 0, e).when(cut >= 3, s).otherwise(even).cast("int").alias("size"))


def curve_sample(sizes: DataFrame, k: int) -> DataFrame:
    """(image_id, sample, stroke_id, size): k evenly spaced strokes of each image's curve, first and last among them.

    Both sides are dealt by stroke: sizes are often made by exploding a small table, which the optimiser takes for small and would broadcast.
    """
    ends = sizes.groupBy("image_id").agg((F.max("stroke_id") + 1).alias("n"))
    at = ends.select("image_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(max(k - 1, 1))).cast("int"))).alias("sample", "stroke_id"))
    return at.join(sizes.hint("merge"), ["image_id", "stroke_id"]).select("image_id", "sample", "stroke_id", "size")


def quadrant_depth(df: DataFrame, most: int = 8) -> DataFrame:
    """df with depth: how often halving rows and columns in turn leaves the halved side at least as long as size.

    The first side that would fall short ends it, even where the other could go on.
    """
    state = F.struct(F.col("height").cast("int").alias("h"), F.col("width").cast("int").alias("w"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def halve(a, k):
        rows = k % 2 == 0
        side = F.floor(F.when(rows, a["h"]).otherwise(a["w"]) / 2).cast("int")
        go = a["on"] & (side >= F.col("size"))
        return F.struct(F.when(go & rows, side).otherwise(a["h"]).alias("h"), F.when(go & ~rows, side).otherwise(a["w"]).alias("w"), (a["n"] + go.cast("int")).alias("n"), go.alias("on"))

    return df.withColumn("depth", F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), state, halve, lambda a: a["n"]))


def quadrant_bounds(df: DataFrame, depth: int, padding: int = 0) -> DataFrame:
    """A row for each region of each row of df (height, width, size): code and the bounds r0, c0, r1, c1 of stroke origins.

    The region's end shrinks by the size, both ends are padded, and then held within 0..side - size; an empty range
    becomes one place.
    """
    out = df.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << depth) - 1))).alias("code"))
    names = [("r0", "r1", "height"), ("c0", "c1", "width")]
    out = out.withColumns({c: v for lo, hi, side in names for c, v in ((lo, F.lit(0)), (hi, F.col(side).cast("int")))})
    for k in range(depth):
        lo, hi, _ = names[k % 2]
        bit = F.shiftright("code", depth - 1 - k).bitwiseAND(F.lit(1))
        mid = F.floor((F.col(lo) + F.col(hi)) / 2).cast("int")
        out = out.withColumns({lo: F.when(bit == 1, mid).otherwise(F.col(lo)), hi: F.when(bit == 1, F.col(hi)).otherwise(mid)})
    for lo, hi, side in names:
        most = F.greatest(F.lit(0), F.col(side) - F.col("size"))
        held = lambda c, most=most: F.greatest(F.lit(0), F.least(most, c))
        out = out.withColumns({lo: held(F.col(lo) - padding), hi: held(F.col(hi) - F.col("size") + padding)})
        out = out.withColumn(hi, F.when(F.col(hi) <= F.col(lo), F.col(lo) + 1).otherwise(F.col(hi)))
    return out


def size_accounting(params: DataFrame, schedule_bits: DataFrame | None = None) -> DataFrame:
    """params with header_bits, body_bits, bits, original_bits, fits: the encoded size without encoding.

    params: image_id, width, height, entries (of the codebook), stroke_count, downsampled, thumbnail, thumb_h, thumb_w, cycle.
    schedule_bits: (image_id, bits) of region and channel switches. fits is false where a field overflows its width.
    """
    flag = lambda c: F.col(c).cast("int")
    header = 240 + 9 * F.col("entries") + 32 * flag("downsampled") + (20 + 24 * F.col("thumb_h") * F.col("thumb_w")) * flag("thumbnail") + 40 * flag("cycle")
    per_code = F.when(F.col("entries") >= 2, F.length(F.bin(F.col("entries") - 1))).otherwise(0)
    df = params
    switches = F.lit(0)
    if schedule_bits is not None:
        df = df.join(schedule_bits.select("image_id", F.col("bits").alias("__switches")), "image_id", "left")
        switches = F.coalesce("__switches", F.lit(0))
    df = df.withColumns({"header_bits": header.cast("long"), "body_bits": (switches + 4 * per_code * F.col("stroke_count")).cast("long"), "original_bits": (F.col("width").cast("long") * F.col("height") * 24)})
    fits = (F.col("stroke_count") < 1 << 20) & (F.col("thumb_h") <= 1023) & (F.col("thumb_w") <= 1023) & (F.col("entries") >= 2)
    return df.withColumns({"bits": F.col("header_bits") + F.col("body_bits"), "fits": fits}).drop("__switches")
