"""The scalar helpers as SQL functions, for queries written in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, type, body).
FUNCTIONS = {
    "clip_add": ("v INT, m INT", "INT", "greatest(0, least(255, v + m))"),
    "code_bits": ("entries INT", "INT", "CASE WHEN entries >= 2 THEN length(bin(entries - 1)) ELSE 0 END"),
    "nearest_code": ("total BIGINT, n BIGINT, book ARRAY<INT>", "INT", "array_min(transform(book, (m, i) -> named_struct('d', abs(m * n - total), 'i', i))).i"),
    "pack_signed": ("v INT, width INT", "STRING", "concat(CASE WHEN v >= 0 THEN '1' ELSE '0' END, lpad(bin(abs(v)), width - 1, '0'))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the helpers temporary functions of the session; their bodies are expanded into the plans that use them."""
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
