"""Tables of rasters, strokes, runs and parameters made from the given tables, as SQL that two engines run alike.

Markers in the SQL: {t:name} a given table, {r:n:x} the numbers 0..n-1 as x, {div} the whole quotient.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

H, W = 24, 32
BOOK = [-10, 0, 5, 20]
#: (config_id, size of squares, codebook).
CONFIGS = [(0, 8, [-20, 0, 20]), (1, 4, [-20, 0, 20]), (2, 4, [-40, -10, 0, 10, 40]), (3, 2, [-20, 0, 20])]
BOOKS = {0: BOOK, 1: [-40, -10, 0, 10, 40], 2: [5, 0, -5, 0]}

PX_LI = f"""
SELECT g.image_id, g.channel, g.row, g.col,
       CAST(LEAST(255, COALESCE(CASE g.channel WHEN 0 THEN q*4 WHEN 1 THEN d*20 ELSE t*25 END, 0)) AS INT) AS value
FROM (SELECT image_id, channel, row, col FROM (SELECT DISTINCT l_suppkey AS image_id FROM {{t:lineitem}}) i
      CROSS JOIN {{r:3:channel}} CROSS JOIN {{r:{H}:row}} CROSS JOIN {{r:{W}:col}}) g
LEFT JOIN (SELECT l_suppkey AS image_id, CAST(l_orderkey % {H} AS INT) AS row, CAST(l_partkey % {W} AS INT) AS col,
             SUM(CAST(l_quantity AS BIGINT)) AS q, SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS d, SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS t
           FROM {{t:lineitem}} GROUP BY 1,2,3) v ON g.image_id=v.image_id AND g.row=v.row AND g.col=v.col"""

SPARSE = f"""
SELECT l_suppkey AS image_id, 0 AS channel, CAST(l_orderkey % {H} AS INT) AS row, CAST(l_partkey % {W} AS INT) AS col,
       CAST(LEAST(255, SUM(CAST(l_quantity AS BIGINT))*4) AS INT) AS value
FROM {{t:lineitem}} GROUP BY 1,2,3,4"""

STROKES = f"""
SELECT image_id, stroke_id, channel,
  CAST(CASE stroke_id WHEN 60 THEN 30 WHEN 61 THEN 22 ELSE (image_id*7919 + stroke_id*104729 + 13) % ({H} - size) END AS INT) AS row,
  CAST(CASE stroke_id WHEN 60 THEN 0 WHEN 61 THEN 29 ELSE (image_id*6271 + stroke_id*15485863 + 7) % ({W} - size) END AS INT) AS col,
  size,
  CAST((image_id + stroke_id) % 4 AS INT) AS i0, CAST((image_id + 3*stroke_id + 1) % 4 AS INT) AS i1,
  CAST((image_id + stroke_id*stroke_id + 2) % 4 AS INT) AS i2, CAST((3*image_id + stroke_id + 3) % 4 AS INT) AS i3
FROM (SELECT image_id, CAST(n AS INT) AS stroke_id, CAST(n % 3 AS INT) AS channel,
        CAST(CASE WHEN n = 61 THEN 6 WHEN n % 10 = 9 THEN 5 ELSE 2 + 2*FLOOR((61-n)/15) END AS INT) AS size
      FROM (SELECT DISTINCT l_suppkey AS image_id FROM {{t:lineitem}}) i CROSS JOIN {{r:62:n}}) b"""

STROKE_LOG = """
SELECT user_id % 16 AS image_id, event_id AS stroke_id, ts, CAST(event_id % 3 AS INT) AS channel,
       CAST((event_id*7919) % 20 AS INT) AS row, CAST((event_id*104729) % 28 AS INT) AS col, CAST(4 AS INT) AS size,
       CAST(event_id % 4 AS INT) AS idx, CAST(2 AS BIGINT) AS bits
FROM {t:events}"""

#: A parameter row for each customer: sizes from 16 x 16 on, some parameters null.
IMAGES = """
SELECT c_custkey AS image_id, CAST(16 + (c_custkey*7919) % 4000 AS INT) AS width, CAST(16 + (c_custkey*104729) % 3000 AS INT) AS height,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN 32 ELSE 16 END AS INT) AS rate_init, c_custkey % 2 = 0 AS thumbnail,
       CAST(CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 10 + c_custkey WHEN 2 THEN 20000 WHEN 3 THEN 20001 ELSE 1048000 + c_custkey END AS INT) AS stroke_count,
       CAST(CASE WHEN c_custkey % 7 = 0 THEN 0.5 END AS DOUBLE) AS cutoff, CAST(NULL AS DOUBLE) AS softness, CAST(NULL AS DOUBLE) AS progress,
       CAST(NULL AS DOUBLE) AS size_start, CAST(CASE WHEN c_custkey % 11 = 0 THEN 0.02 END AS DOUBLE) AS size_end,
       CAST(CASE WHEN c_custkey % 13 = 0 THEN 0.25 END AS DOUBLE) AS warmup
FROM {t:customer}"""

#: Curve parameters of each customer: short curves, all branches.
CURVES = """
SELECT c_custkey AS image_id, CAST(1 + (c_custkey*31) % 40 AS INT) AS stroke_count, CAST(6 + c_custkey % 25 AS INT) AS start, CAST(2 + c_custkey % 3 AS INT) AS end_,
       CAST(c_custkey % 8 AS DOUBLE) * 0.5 + CAST(CASE WHEN c_custkey % 7 = 3 THEN 0.123456 ELSE 0 END AS DOUBLE) AS cutoff, CAST(c_custkey % 3 AS DOUBLE) * 0.5 AS softness, CAST(c_custkey % 5 AS DOUBLE) * 0.25 + CAST(CASE WHEN c_custkey % 11 = 3 THEN 0.012345 ELSE 0 END AS DOUBLE) AS progress,
       CAST(20 + (c_custkey*7919) % 500 AS INT) AS height, CAST(20 + (c_custkey*104729) % 700 AS INT) AS width, CAST(1 + c_custkey % 19 AS INT) AS size
FROM {t:customer}"""

RUNS = f"""
SELECT image_id, 'uniform' AS codec, quality,
       SUM(CAST(LENGTH(BIN(CAST(FLOOR(255/step) AS BIGINT))) AS BIGINT)) AS bits,
       CAST(FLOOR(SUM(e*e)*1.0/COUNT(*)) AS BIGINT) AS mse
FROM (SELECT image_id, quality, step, CAST(value - LEAST(255, FLOOR(value/step)*step + FLOOR(step/2)) AS BIGINT) AS e
      FROM (SELECT p.image_id, p.value, q.quality, 101-q.quality AS step
            FROM {{px}} p CROSS JOIN (SELECT CAST(1+9*n AS INT) AS quality FROM {{r:12:n}}) q) a) b
GROUP BY image_id, quality, step
UNION ALL
SELECT image_id, 'tile' AS codec, side AS quality, CAST(COUNT(*)*8 AS BIGINT) AS bits,
       CAST(FLOOR(SUM(sse)*1.0/SUM(n)) AS BIGINT) AS mse
FROM (SELECT image_id, side, COUNT(*) AS n,
             SUM(CAST(value AS BIGINT)*value) - 2*FLOOR(SUM(value)*1.0/COUNT(*))*SUM(value)
               + COUNT(*)*FLOOR(SUM(value)*1.0/COUNT(*))*FLOOR(SUM(value)*1.0/COUNT(*)) AS sse
      FROM (SELECT image_id, channel, side, FLOOR(row/side) AS tr, FLOOR(col/side) AS tc, value
            FROM {{px}} CROSS JOIN (SELECT 2 AS side UNION ALL SELECT 4 UNION ALL SELECT 8) k) a
      GROUP BY image_id, channel, side, tr, tc) b
GROUP BY image_id, side"""

PX_EMB = {
    "spark": """
SELECT vec_id div 3 AS image_id, CAST(vec_id % 3 AS INT) AS channel, CAST(pos div 8 AS INT) AS row, CAST(pos % 8 AS INT) AS col,
       CAST(GREATEST(0, LEAST(255, FLOOR((CAST(v AS DOUBLE)+0.5D)*255))) AS INT) AS value
FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM {t:embeddings})
WHERE vec_id < 3*((SELECT COUNT(*) FROM {t:embeddings}) div 3)""",
    "duck": """
SELECT vec_id // 3 AS image_id, CAST(vec_id % 3 AS INT) AS channel, CAST(pos // 8 AS INT) AS row, CAST(pos % 8 AS INT) AS col,
       CAST(GREATEST(0, LEAST(255, FLOOR((CAST(v AS DOUBLE)+0.5::DOUBLE)*255))) AS INT) AS value
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding,1)-1 AS pos FROM embeddings) e
WHERE vec_id < 3*((SELECT COUNT(*) FROM embeddings) // 3)""",
}


def render(sql: str, engine: str, sf_dir: str = "") -> str:
    """The SQL for `spark` (reading the tables' Parquet below sf_dir) or `duck` (tables are views)."""
    sql = sql.replace("{px}", f"({PX_LI})")
    if engine == "spark":
        sql = re.sub(r"\{t:(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql)
        return re.sub(r"\{r:(\d+):(\w+)\}", r"(SELECT CAST(id AS INT) AS \2 FROM range(\1))", sql)
    sql = re.sub(r"\{t:(\w+)\}", r"\1", sql)
    return re.sub(r"\{r:(\d+):(\w+)\}", r"(SELECT CAST(range AS INT) AS \2 FROM range(\1))", sql)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(render(sql, "spark", sf_dir))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PX_LI's rows, in partitions by image: an image's places, H * W at most, come to one row, which unfolds beside all blank places where it lies.

    Aggregates and windows by image need no shuffle of cells then. The number of partitions is Spark's for shuffles, as a count by bytes would be
    made for the packed rows.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    total = lambda c: F.sum(c.cast("long"))
    place = [F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") % H).cast("int").alias("row"), (F.col("l_partkey") % W).cast("int").alias("col")]
    sums = li.groupBy(*place).agg(total(F.col("l_quantity")).alias("q"), total(F.round(F.col("l_discount") * 100)).alias("d"), total(F.round(F.col("l_tax") * 100)).alias("t"))
    value = lambda c, by: F.least(F.lit(255), F.coalesce(F.col(c) * by, F.lit(0))).cast("int")
    inside = F.col("image_id").isNotNull() & (F.col("row") >= 0) & (F.col("col") >= 0)
    entry = F.struct((F.col("row") * W + F.col("col")).alias("at"), value("q", 4).alias("v0"), value("d", 20).alias("v1"), value("t", 25).alias("v2"))
    images = sums.select("image_id", F.when(inside, entry).alias("e")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id").groupBy("image_id").agg(F.collect_list("e").alias("some"))
    blank = F.expr(f"transform(sequence(0, {H * W - 1}), k -> struct(k AS at, CAST(NULL AS INT) AS v0, CAST(NULL AS INT) AS v1, CAST(NULL AS INT) AS v2))")
    places = images.select("image_id", F.inline(F.concat("some", blank))).groupBy("image_id", "at").agg(*[F.coalesce(F.max(f"v{k}"), F.lit(0)).alias(f"v{k}") for k in range(3)])
    return places.select("image_id", F.posexplode(F.array("v0", "v1", "v2")).alias("channel", "value"), "at").select("image_id", "channel", (F.col("at") / W).cast("int").alias("row"), (F.col("at") % W).alias("col"), "value")
