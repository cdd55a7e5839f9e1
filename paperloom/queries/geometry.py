"""Deterministic pages, regions and captions from lineitem, for the review queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines 1, 3, 5 ... of an order are regions, lines 2, 4, 6 ... captions of a page of 600 by 800.
SQL = """
line AS (SELECT l_orderkey AS page_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
box AS (SELECT page_id, n, q, p, s, (p * 7 + n * 13) % 400 AS x, (s * 11 + n * 37) % 600 AS y, 80 + q * 2 AS w, CASE WHEN n % 2 = 0 THEN 20 ELSE 60 + q END AS h FROM line),
region AS (SELECT page_id, n, MAX(x) AS x0, MAX(y) AS y0, MAX(x + w) AS x1, MAX(y + h) AS y1, MAX(q) AS q FROM box WHERE n % 2 = 1 GROUP BY page_id, n),
caption AS (SELECT page_id, n, MAX(x) AS x0, MAX(y) AS y0, MAX(x + w) AS x1, MAX(y + h) AS y1, MAX(q) AS q FROM box WHERE n % 2 = 0 GROUP BY page_id, n)
"""


def tables(lineitem: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pages, regions, captions as operators.review has them."""
    n, p, s, q = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    x, y = (p * 7 + n * 13) % 400, (s * 11 + n * 37) % 600
    w, h = 80 + q * 2, F.when(n % 2 == 0, 20).otherwise(60 + q)
    boxes = lineitem.select(F.col("l_orderkey").alias("page_id"), n.alias("n"), q.alias("q"), x.alias("x"), y.alias("y"), (x + w).alias("x1"), (y + h).alias("y1"))
    # an order can repeat a line number: one box for each
    boxes = boxes.groupBy("page_id", "n").agg(*[F.max(c).alias(c) for c in ("q", "x", "y", "x1", "y1")])
    box = F.array(*[F.col(c).cast("double") for c in ("x", "y", "x1", "y1")])
    kind = F.when(F.col("q") % 5 == 0, "table").otherwise("image")
    regions = boxes.where("n % 2 = 1").select("page_id", F.concat(F.lit("r"), F.col("n").cast("string")).alias("region_id"), F.col("n").alias("seq"), box.alias("bbox"), kind.alias("type"), F.lit(None).cast("string").alias("caption_id"))
    label = F.when(F.col("q") % 4 == 0, "table").otherwise("figure")
    captions = boxes.where("n % 2 = 0").select("page_id", F.concat(F.lit("c"), F.col("n").cast("string")).alias("caption_id"), box.alias("bbox"), label.alias("kind"), (F.col("q") % 7).cast("string").alias("label"))
    pages = boxes.select("page_id").distinct().select("page_id", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return pages, regions, captions
