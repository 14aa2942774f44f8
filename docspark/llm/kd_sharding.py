"""Sharding by a k-d tree over metadata, split at weighted medians, in DataFrame functions throughout.

A node is split along its widest dimension where the bytes on the left reach their share. The
median comes from histograms of bytes over the digits of an order-preserving key, of which only
the bucket that holds the median is refined; all nodes of a level are split by the same jobs.
The key's low digits are a hash of the text, so a dimension with few values still splits evenly.
Rows of equal text share a key and stay together, except groups too large for that.
"""

from __future__ import annotations

import math
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Bits of a key, of a histogram digit, and of the value of a dimension in a key.
KEY_BITS, DIGIT_BITS, VALUE_BITS = 60, 12, 20
#: A digit is refined while its bucket holds more than this share of its node.
FINE = 1 / 20_000
#: A group of equal texts with more than this part of a shard's bytes is dealt by row.
GROUP_PART = 0.25


def _strings(c: Column, skip: int) -> Column:
    """A number that orders strings by six bytes after the ``skip`` that all of them share; empty ones and nulls come first."""
    head = F.rpad(F.substring(F.hex(F.encode(F.coalesce(c, F.lit("")), "utf-8")), 2 * skip + 1, 12), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _shared(lo: str | None, hi: str | None) -> int:
    """Bytes that all strings from ``lo`` to ``hi`` begin with."""
    return len(commonprefix([(lo or "").encode(), (hi or "").encode()]))


def assign(rows: DataFrame, n_shards: int | None, target_bytes: int | None, dims: list[str]) -> tuple[DataFrame, int]:
    """Give each row (doc_id, size, group, ``dims`` as numbers) its leaf; returns also the number of leaves."""
    head = rows.agg(F.sum("size").alias("w"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    total = head["w"] or 0
    leaves = n_shards or max(1, math.ceil(total / max(1, target_bytes or 1)))
    groups = rows.groupBy("group").agg(F.sum("size").alias("w"), F.min(F.struct("doc_id", *dims)).alias("m"))
    # By their size there are at most leaves / GROUP_PART of these.
    cap = max(1.0, GROUP_PART * total / leaves)
    hot = [r.group for r in groups.where(F.col("w") > cap).select("group").collect()]
    is_hot = F.col("group").isin(hot) if hot else F.lit(False)
    same = rows.where(~is_hot).drop("row", *dims).join(groups.where(~is_hot).select("group", F.col("m").alias("m")), "group")
    same = same.select("doc_id", "size", "text_crc32", "group", F.xxhash64("group").alias("u"), *[F.col(f"m.{d}").alias(d) for d in dims])
    own = rows.where(is_hot).select("doc_id", "size", "text_crc32", "group", F.xxhash64("group", "doc_id", "row").alias("u"), *dims)

    def key(d: str) -> Column:
        lo, hi = float(head[f"lo_{d}"] or 0), float(head[f"hi_{d}"] or 0)
        value = F.floor((F.col(d) - lo) / (hi - lo) * ((1 << VALUE_BITS) - 1)) if hi > lo else F.lit(0)
        return F.shiftleft(value.cast("long"), KEY_BITS - VALUE_BITS) + F.shiftrightunsigned("u", 64 - KEY_BITS + VALUE_BITS)

    keyed = keep(same.unionByName(own).select("doc_id", "size", "text_crc32", "group", *[key(d).alias(f"k_{d}") for d in dims]))
    # node -> (leaves below it, first leaf); splits: node -> (dimension, key): left if below it.
    nodes: dict[int, tuple[int, int]] = {1: (leaves, 0)}
    node: Column = F.lit(1)
    leaf_of: dict[int, int] = {}
    while nodes:
        for i in [i for i, (n, _) in nodes.items() if n == 1]:
            leaf_of[i] = nodes.pop(i)[1]
        if not nodes:
            break
        at = keyed.withColumn("node", node).where(F.col("node").isin(list(nodes)))
        span = at.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(f"k_{d}") - F.min(f"k_{d}")).alias(d) for d in dims])
        widths = {r.node: r for r in span.collect()}  # a row per node
        plan = {i: {"dim": max(dims, key=lambda d: widths[i][d] >> (KEY_BITS - VALUE_BITS)) if i in widths else dims[0], "base": 0} for i in nodes}
        for i, x in plan.items():
            x["want"] = (widths[i].w if i in widths else 0) * (nodes[i][0] // 2) / nodes[i][0]
            x["fine"], x["open"] = FINE * (widths[i].w if i in widths else 0), i in widths
        chosen = reduce(lambda c, i: c.when(F.col("node") == i, F.col(f"k_{plan[i]['dim']}")), plan, F.when(F.lit(False), F.lit(0).cast("long")))
        for digit in range(KEY_BITS // DIGIT_BITS):
            shift = KEY_BITS - (digit + 1) * DIGIT_BITS
            still = [i for i, x in plan.items() if x["open"]]
            if not still:
                break
            inside = reduce(lambda c, i: c | ((F.col("node") == i) & (F.shiftright("k", shift + DIGIT_BITS) == plan[i]["base"] >> (shift + DIGIT_BITS))), still, F.lit(False))
            hist = at.select("node", "size", chosen.alias("k")).where(inside).groupBy("node", F.shiftright("k", shift).alias("b")).agg(F.sum("size").alias("w")).collect()
            for i in still:  # at most 4096 buckets a node
                x = plan[i]
                for r in sorted((r for r in hist if r.node == i), key=lambda r: r.b):
                    if x["want"] <= r.w:
                        up = x["want"] > r.w / 2
                        x["base"], x["open"] = r.b << shift, r.w > x["fine"] and shift > 0
                        if not x["open"] and up:
                            x["base"] = (r.b + 1) << shift
                        break
                    x["want"] -= r.w
                else:
                    x["open"] = False
        step = F.when(F.lit(False), F.lit(0))
        for i, x in plan.items():
            step = step.when(F.col("node") == i, F.col(f"k_{x['dim']}") >= F.lit(x["base"]))
        parent = node
        picks = reduce(lambda c, i: c.when(parent == i, F.lit(2 * i) + (F.col(f"k_{plan[i]['dim']}") >= F.lit(plan[i]["base"])).cast("int")), plan, F.when(F.lit(False), F.lit(0)))
        node = picks.otherwise(parent)
        below = {}
        for i, (n, first) in nodes.items():
            below[2 * i], below[2 * i + 1] = (n // 2, first), (n - n // 2, first + n // 2)
        nodes = below
        # The tree so far as a table: else the expression doubles with each level.
        keyed = keep(keyed.withColumn("at", node).drop(*(["node"] if "node" in keyed.columns else [])).withColumnRenamed("at", "node"))
        node = F.col("node")
    if "node" not in keyed.columns:
        keyed = keyed.withColumn("node", F.lit(1))
    names = F.create_map(*[F.lit(v) for i, s in leaf_of.items() for v in (i, s)])
    return keyed.withColumn("shard", F.element_at(names, F.col("node")).cast("int")), leaves


def shard(docs: DataFrame, *, n_shards: int | None = 16, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row: doc_id, size, text_crc32, shard, slot (gapless from 0 within its shard).

    ``n_shards`` leaves, or as many as ``target_bytes`` asks for. Null text counts as empty bytes,
    null metadata as the empty string; rows with equal keys and texts tie, and are then told apart
    by their place in the table; an empty table gives an empty result; other columns are not read.
    """
    lang_, source_ = F.col(lang).cast("string"), F.col(source).cast("string")
    ends = docs.agg(*[f(F.when(c != "", c)).alias(f"{n}{i}") for i, f in enumerate((F.min, F.max)) for n, c in (("lang", lang_), ("source", source_))]).first()
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    rows = keep(
        docs.select(
            F.col(key).alias("doc_id"), size.alias("size"), F.crc32(raw).cast("long").alias("text_crc32"),
            F.concat_ws("-", F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.crc32(raw), size).alias("group"),
            F.log2(size).alias("bytes"), _strings(lang_, _shared(ends.lang0, ends.lang1)).alias("lang"), _strings(source_, _shared(ends.source0, ends.source1)).alias("source"),
            F.monotonically_increasing_id().alias("row"),  # written once, so it stays
        )
    )
    got, leaves = assign(rows, n_shards, target_bytes, ["bytes", "lang", "source"])
    # Slots: counts by shard and block give each block its first slot; blocks keep the sort distributed.
    n_blocks = 256
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int")
    blocked = got.withColumn("block", block)
    sums = blocked.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("shard", "block", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("first"))
    inner = Window.partitionBy("shard", "block").orderBy("doc_id", "group")
    placed = blocked.withColumn("i", F.row_number().over(inner)).join(F.broadcast(first) if leaves <= 64 else first, ["shard", "block"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("i") - 1).cast("long").alias("slot"))


def op7(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
