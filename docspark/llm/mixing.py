"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a token budget. Whole multiples of a source are taken outright; the rest is
a nested sample: rows in hash order as far as the budget reaches. The threshold comes from
histograms of tokens by source and hash bucket, of which only the bucket that the budget ends
in is refined, level by level, so no source is ever sorted. A hot source is one row a task in
the partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep

#: Hex digits of the hash a histogram level covers, and the number of levels: 4096 buckets each.
DIGITS, LEVELS = 3, 3
#: Tables of so many sources at most, some tens of bytes each, are broadcast.
MOST_BROADCAST = 100_000


def budgets(sizes: dict[str | None, int], weights: Sequence[float], share: float, most: float) -> dict[str | None, float]:
    """Words for each source: ``share`` of all words split by weight, none above ``most`` times
    its source; what is above goes to the others by weight until none is above.

    Sources are taken by code point, null last; weights repeat along that order. A weight of 0 takes nothing.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    open_ = sorted(order, key=lambda s: most * sizes[s] / weight[s] if weight[s] > 0 else math.inf)
    total = sum(weight.values())
    for s in open_:
        got = min(most * sizes[s], left * weight[s] / total if weight[s] > 0 else 0.0)
        out[s], left, total = got, left - got, total - weight[s]
    return out


def _measures(key: str, text: str) -> tuple[Column, Column]:
    """Words of a row, and its hash."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return size, F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))


def thresholds(docs: DataFrame, weights: Sequence[float], share: float, most: float, source: str, key: str, text: str) -> tuple[DataFrame, dict]:
    """The measured rows (doc_id, source, size, h), and by source: words, target, whole copies, highest hash of one more."""
    spark = docs.sparkSession
    size, h = _measures(key, text)
    rows = keep(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), h.alias("h")))
    # One row per source: the mixture is defined by listing its sources, so this is bounded by configuration.
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = budgets(sizes, weights, share, most)
    state = {}
    for s, n in sizes.items():
        whole = int(target[s] // n) if n else 0
        state[s] = {"whole": whole, "rest": target[s] - whole * n, "prefix": ""}

    def table() -> DataFrame:
        data = [(s, sizes[s], float(target[s]), x["whole"], float(x["rest"]), x["prefix"]) for s, x in state.items()]
        return spark.createDataFrame(data, "s string, source_size long, target double, whole int, rest double, prefix string")

    def joined(df: DataFrame) -> DataFrame:
        t = table()
        return df.join(F.broadcast(t) if len(state) <= MOST_BROADCAST else t, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    for level in range(LEVELS):
        done = level * DIGITS
        bucket = F.substring("h", done + 1, DIGITS)
        by = joined(rows).where(F.substring("h", 1, done) == F.col("prefix")) if level else joined(rows)
        hist = by.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ends = (
            hist.withColumn("upto", F.sum("n").over(run))
            .where(F.col("upto") > F.col("rest"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("m"))
        )
        found = {r.source: r.m for r in ends.collect()}
        for s, x in state.items():
            if s in found:
                x["prefix"] += found[s].bucket
                x["rest"] -= found[s].before
            elif not level or len(x["prefix"]) == done:
                x["prefix"] += "g"  # beyond every hex digit: the whole bucket fits
    # The last bucket, about one in 2**36 of a source: the hash that the budget ends in counts if half of its words fit.
    edge = joined(rows).where(F.substring("h", 1, DIGITS * LEVELS) == F.col("prefix")).groupBy("source", "rest", "h").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    fits = edge.withColumn("fits", 2 * upto - F.col("n") <= 2 * F.col("rest")).where("fits").groupBy("source").agg(F.max("h").alias("top"))
    tops = {r.source: r.top for r in fits.collect()}
    # A source's threshold: its rows up to this hash are taken once more.
    bounds = {s: (sizes[s], float(target[s]), x["whole"], tops.get(s, x["prefix"])) for s, x in state.items()}
    return rows, bounds


def _draw(rows: DataFrame, bounds: dict, most: int) -> DataFrame:
    """``rows`` (source, size, h) with source_size, target and copies."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(s, *b) for s, b in bounds.items()], "s string, source_size long, target double, whole int, top string")
    table = F.broadcast(table) if len(bounds) <= MOST_BROADCAST else table
    extra = (F.col("h") <= F.col("top")).cast("int")
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + extra, F.lit(most))).otherwise(F.lit(0))
    return rows.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("copies", copies.cast("int")).drop("whole", "top")


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies.

    ``copies`` says how often the mix takes the row. Null text has size 0; a null source is a
    source of its own; rows without words are not taken; an empty table gives an empty result. Rows
    with equal key and text are taken alike. Other columns are not read.
    """
    rows, bounds = thresholds(docs, weights, share, most, source, key, text)
    return _draw(rows, bounds, most).drop("h")


def resample(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as the mix takes them, with all their columns; no shuffle of texts."""
    _, bounds = thresholds(docs, weights, share, most, source, key, text)
    size, h = _measures(key, text)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"), size.alias("size"), h.alias("h"))
    taken = _draw(inner, bounds, most).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def op6(docs: DataFrame) -> DataFrame:
    m = mix(docs)
    return m.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM w),
f AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
         - coalesce(sum(cap) OVER (ORDER BY ratio, source COLLATE C ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(w) OVER (ORDER BY ratio DESC, source COLLATE C DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w_left FROM c),
level AS (SELECT arg_min(left_ / w_left, ratio) AS lvl FROM f WHERE left_ / w_left <= ratio),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT lvl FROM level), 1e300)) AS target FROM c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
x AS (SELECT d.*, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(d.size) OVER (PARTITION BY d.source, h) AS unit
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * least(whole + CASE WHEN 2 * upto - unit <= 2 * rest THEN 1 ELSE 0 END, 2) END AS BIGINT) AS taken
FROM x
"""
