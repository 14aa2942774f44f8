"""Near-duplicates by an n-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent by a sketch of their document frequencies. Two sets with
Jaccard t or more share at least l shingles in their prefixes of n - ceil(t n) + l shingles. Each
document picks its own l, from 1 to ``MOST``, by the cost its candidates would have: a longer prefix
meets more lists but demands more shared shingles. Pairs with enough of them are verified on whole sets.

Groups of copies do not become pairs: documents with equal sets are one class from the start, each
shingle's list is first linked to one member of like size, and of the lists that still join classes
of different components only short ones pair them. A long one, of near copies that mostly do not link, takes a
hub again and goes on with the shingles that its members have beyond the hub, which few of them share. There
a pair must meet in the prefix of its smaller set, which is shorter: a partner as large shares more with it.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import chunks, shingle_sets
from .common import clean, keep, tidy
from .components import components

#: Largest number of prefix shingles that two documents must share before verification.
MOST = 4
#: The frequency sketch has 2**SKETCH_BITS counters at most (64 MB a worker), fewer for little text.
SKETCH_BITS, SKETCH_LEAST, SKETCH_LOAD = 24, 16, 32
SKETCH_BLOCK = 1 << 14
#: So many tasks' parts of a block (64 kB each, compressed) are summed by one group, so many sums by the next.
SUMMED = 64
#: So many candidates at most are broadcast (64 MB) to find their texts.
MOST_BROADCAST = 500_000
#: Lists of as many pairs as so many members have at most make them all. What is left does if it is no more than so many
#: pairs for each class, or if after so many turns the turn before has not halved it.
SHORT, TURNS, PAIRS = 32, 6, 0.25


def _scan(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for b in batches:
            n, sig = [], []
            for _, _, data, offsets in chunks(b.column("text")):
                sets = list(shingle_sets(data, offsets, size))
                at, n_at = np.unique((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                counts[at] += n_at.astype(np.int32)
                n += [len(s) for s in sets]
                sig += [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], _SCANNED)
        blocks = [(i, counts[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK]) for i in range(-(-len(counts) // SKETCH_BLOCK))]
        blocks = [(i, zlib.compress(c.astype("<i4").tobytes(), 1)) for i, c in blocks if c.any()]
        k, part = len(blocks), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([i for i, _ in blocks], pa.int32()), pa.array([part] * k, pa.int64()), pa.array([c for _, c in blocks], pa.binary())],
            _SCANNED,
        )

    return tidy(run)


_SCANNED = ["doc_id", "n", "sig", "block", "part", "counts"]


def _levels(sketch: DataFrame, bits: int) -> np.ndarray:
    """How far above the usual load each counter is: 0, or 1 more than the binary logarithm."""

    def add(g: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for c in g["counts"]:
            one = np.frombuffer(zlib.decompress(c.as_py()), "<i4")
            total[: len(one)] += one
        total = np.minimum(total, np.iinfo(np.int32).max).astype("<i4").tobytes()
        return pa.table({"block": g["block"][:1], "part": g["part"][:1], "counts": pa.array([zlib.compress(total, 1)], pa.binary())})

    parts = (sketch.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        sketch = sketch.withColumn("part", F.expr(f"part DIV {SUMMED}")).groupBy("block", "part").applyInArrow(add, "block int, part long, counts binary")
        parts = -(-parts // SUMMED)
        if parts == 1:
            break
        sketch = keep(sketch)
    counts = np.zeros(1 << bits, np.int32)
    for r in sketch.collect():  # a row for each block, 64 MB before compression at most
        one = np.frombuffer(zlib.decompress(r.counts), "<i4")[: len(counts) - r.block * SKETCH_BLOCK]
        counts[r.block * SKETCH_BLOCK : r.block * SKETCH_BLOCK + len(one)] = one
    usual = max(4.0, 1.5 * float(np.median(counts)))
    levels = np.zeros(len(counts), np.uint8)
    high = np.flatnonzero(counts > usual)
    for lo in range(0, len(high), SKETCH_BLOCK):
        at = high[lo : lo + SKETCH_BLOCK]
        levels[at] = np.minimum(40, 1 + np.log2(counts[at] / usual).astype(int))
    return levels


def _rare_first(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A set in the order of prefixes. Sets are sorted by hash, so a stable sort by level orders by (level, hash)."""
    bits = len(level).bit_length() - 1
    return s[np.argsort(level[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")].view(np.int64)


def _place(prefix: np.ndarray, level: np.ndarray) -> int:
    """Where the order of prefixes has the last shingle of one, to the last 7 bits of its hash; -1 for none."""
    if not len(prefix):
        return -1
    h = int(prefix[-1]) & 0xFFFFFFFFFFFFFFFF
    return int(level[h >> (65 - len(level).bit_length())]) << 57 | h >> 7


def _sets(size: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, sig = [], []
            for _, _, data, offsets in chunks(b.column("text")):
                for s in shingle_sets(data, offsets, size):
                    out.append(_rare_first(s, levels.value))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("sig0"), pa.array(sig, pa.binary()), _lists(out)], ["node", "sig0", "sig", "toks"])

    return tidy(run)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _mixed(lists: DataFrame) -> DataFrame:
    """The lists whose members are of several components, one of them at least ``short``."""
    several = lists.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("short").alias("any")).where("lo <> hi AND any").select("list")
    return lists.select("list", "rest", "short", "node", "n", "alone", "comp", *[c for c in ("pos", "need", "last") if c in lists.columns]).join(several, "list")


def _pairs(lists: DataFrame, facts: Sequence[str]) -> DataFrame:
    """Pairs a < b of members of a list, of different components, with the ``facts`` of both."""

    def side(e: str) -> DataFrame:
        return lists.select("list", F.col("node").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("comp", *facts)])

    return side("a").join(side("b"), "list").where("a < b AND comp_a <> comp_b")


def _by_smaller(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of like size and different components that meet in a list where the smaller is ``short``."""

    def side(e: str) -> DataFrame:
        return lists.select("list", F.col("node").alias(e), F.col("comp").alias(f"comp_{e}"), F.col("n").alias(f"n_{e}"), F.col("short").alias(f"short_{e}"))

    met = side("x").where("short_x").join(side("y"), "list").where(f"(n_x < n_y OR (n_x = n_y AND x < y)) AND comp_x <> comp_y AND 100 * n_x >= {percent} * n_y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _apart(spokes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists that hold, for all pairs of members of a hub that link and that the hub does not connect, both members; and the links of hubs.

    If x and y link, they share percent / (100 + percent) of the sum of their sizes. As far as the hub has fewer
    shingles in common with x, or with y, than that, they share others: those are searched by prefixes of what
    each has beyond the hub. A list of its own (``rest``) holds members for which the hub has enough.
    """
    hub, own = sets.select(F.col("node").alias("hub"), F.col("toks").alias("th")), sets.select("node", F.col("toks").alias("tn"))
    both = spokes.join(hub, "hub").join(own, "node").withColumn("beyond", F.array_except("tn", "th")).drop("th", "tn")
    both = both.withColumn("i", F.col("n") - F.size("beyond")).withColumn("linked", F.expr(f"{percent + 100} * i >= {percent} * (n + nh)"))
    # A partner shares percent / (100 + percent) of both sizes, so as many as are not the hub's lie beyond it: one as
    # large or larger of twice this size, one smaller of this and the least size that the hub has met and that is like it.
    smallest = spokes.groupBy(F.col("hub").alias("h")).agg(F.min("n").alias("least"))
    both = both.join(smallest, F.col("hub") == F.col("h")).withColumn("least", F.greatest("least", F.expr(f"({percent} * n + 99) DIV 100"))).drop("h")

    def prefix(other: str) -> Column:
        must = F.expr(f"greatest(1, ({percent} * (n + {other}) + {percent + 99}) DIV {percent + 100} - i)")
        return F.greatest(F.lit(0), F.size("beyond") - must + 1).cast("int")

    both = both.withColumn("k", prefix("n")).withColumn("beyond", F.slice("beyond", F.lit(1), prefix("least"))).drop("least")
    both = keep(both.withColumn("comp", F.when(F.col("linked"), F.col("ch")).otherwise(F.col("comp"))))
    prefixes = both.select(F.expr("hub"), F.posexplode("beyond").alias("at", "t"), "k", "node", "n", "alone", "comp")
    lists = prefixes.select(F.xxhash64("hub", "t").alias("list"), F.lit(False).alias("rest"), (F.col("at") < F.col("k")).alias("short"), "node", "n", "alone", "comp")
    # x and y both have enough of the hub only if n(y) <= reach(x) and n(x) <= reach(y); one of them does not link with the hub.
    reach = F.expr(f"{percent + 100} * i DIV {percent} - n")
    facts = both.select("hub", "node", "n", "alone", "comp", "linked", reach.alias("reach"))
    out = F.when(~F.col("linked"), F.col("n")), F.when(~F.col("linked"), F.col("reach"))
    ends = facts.groupBy("hub").agg(F.min("n").alias("least"), F.min(out[0]).alias("least_out"), F.max(out[1]).alias("most_out"))
    near = facts.join(ends, "hub").where("(NOT linked AND reach >= least) OR (n <= most_out AND reach >= least_out)")
    rest = near.select(F.xxhash64("hub").alias("list"), F.lit(True).alias("rest"), F.lit(True).alias("short"), "node", "n", "alone", "comp")
    return keep(_mixed(lists.union(rest))), both.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, *, size: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links).

    Two documents link when 100 * common shingles >= ``percent`` * all their shingles. Words are split at
    ASCII white space, A-Z lower-cased. Null, empty and blank texts have no shingles and link with nothing;
    a null doc_id never names a component unless all its members lack one; repeated rows link as copies;
    an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, chars / 6 / SKETCH_LOAD))), SKETCH_LEAST, SKETCH_BITS))
    scanned = keep(rows.mapInArrow(_scan(size, bits), "doc_id long, n long, sig binary, block int, part long, counts binary"))
    levels = spark.sparkContext.broadcast(_levels(scanned.where("block IS NOT NULL").select("block", "part", "counts"), bits))
    known = scanned.where("sig IS NOT NULL").select("doc_id", "n", "sig")
    classes = keep(known.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, sig, last = [], [], []
            for _, _, data, offsets in chunks(b.column("text")):
                for s in shingle_sets(data, offsets, size):
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                    k = len(s) - (percent * len(s) + 99) // 100 + MOST
                    out.append(_rare_first(s, levels.value)[:k])
                    last.append(_place(out[-1], levels.value))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sig, pa.binary()), _lists(out), pa.array(last, pa.int64())], ["doc_id", "sig", "toks", "last"])

    heads = rows.mapInArrow(tidy(prefix), "doc_id long, sig binary, toks array<long>, last long")
    # Of a class, the representative's prefix alone goes on (all are equal).
    mine = heads.join(classes, "sig").where(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["node"])
    posts = keep(mine.select("node", "n", "last", F.posexplode("toks").alias("pos", "token")))
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = keep(posts.drop("last").join(lists, "token"))

    # Each document's l: the least of (entries its prefix meets) * (cost of one + cost of verifying, rarer with each further match).
    base = F.col("n") - F.expr(f"({percent} * n + 99) DIV 100")

    def cost(l: int) -> Column:
        met = F.sum(F.when(F.col("pos") < base + l, F.col("df") - 1).otherwise(0))
        return met * (1 + F.max("n") / (4.0 * l * l))

    options = shared.groupBy("node").agg(*[cost(l).alias(f"c{l}") for l in range(1, MOST + 1)], F.max("n").alias("n"), F.count(F.lit(1)).alias("lists"))
    least = F.least(*[F.col(f"c{l}") for l in range(1, MOST + 1)])
    # Shingles of the prefix that are in no other prefix. Another document may still hold them beyond its own.
    options = options.withColumn("alone", F.least(F.col("n"), base + MOST) - F.col("lists")).join(posts.where("pos = 0").select("node", "last"), "node")
    chosen = options.select("node", "alone", "last", F.coalesce(*[F.when(F.col(f"c{l}") == least, F.lit(l)) for l in range(1, MOST + 1)]).alias("need"))
    used = keep(shared.join(chosen, "node").where(F.col("pos") < base + F.col("need")).select("token", "node", "n", "pos", "need", "alone", "last"))
    like = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    # What can be shared up to this shingle and after it must reach the overlap that the sizes ask for. Of two prefixes, the one
    # that ends first in the order of shingles is compared in full: what it alone holds stands nowhere in the other document.
    most = "CASE WHEN last_a < last_b THEN n_a - alone_a WHEN last_b < last_a THEN n_b - alone_b ELSE n_a END"
    room = f"{percent + 100} * least(least(pos_a, pos_b) + least(n_a - pos_a, n_b - pos_b), {most}) >= {percent} * (n_a + n_b)"

    def enough(met: DataFrame) -> DataFrame:
        """Pairs of ``met``, a row for each shared shingle, that share as many as the smaller l asks for."""
        k = met.where(like).where(room).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.min(F.least("need_a", "need_b")).alias("need"))
        return k.where("k >= need").select("a", "b")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """(node, toks) of the documents in ``pairs``, from their whole texts."""
        names = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes, "node")
        names = keep(names.select("node", "rep", F.col("sig").alias("sig0")))
        small = names.count() <= MOST_BROADCAST
        found = rows.join(F.broadcast(names) if small else names, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "sig0", "text")
        return keep(found.mapInArrow(_sets(size, levels), "node long, sig0 binary, sig binary, toks array<long>").where("sig = sig0").select("node", "toks").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs)
        a = sets.select(F.col("node").alias("a"), F.col("toks").alias("ta"))
        b = sets.select(F.col("node").alias("b"), F.col("toks").alias("tb"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("i"), (F.size("ta") + F.size("tb")).alias("s"))
        return keep(both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"))

    # 1. Link each list's members to the one of like size with the fewest shingles of its own, the likest to all.
    banded = used.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100) if percent < 100 else 1.0)))
    hubs = banded.groupBy("token", "band").agg(F.min(F.struct("alone", "node", "n", "pos", "need", "last")).alias("h"))
    facts = ("n", "pos", "need", "alone", "last")
    spokes = banded.join(hubs, ["token", "band"]).where("h.node <> node").select(
        F.col("h.node").alias("a"), F.col("node").alias("b"), *[F.col(f"h.{c}").alias(f"{c}_a") for c in facts], *[F.col(c).alias(f"{c}_b") for c in facts]
    )
    stars = keep(enough(spokes))
    links = verified(stars)
    first = components(links)
    # 2. Lists that still hold several components: short ones pair their members, long ones go by a hub.
    named = used.join(first, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    now = keep(_mixed(named.withColumnRenamed("token", "list").withColumn("rest", F.lit(False)).withColumn("short", F.lit(True))))
    asked, more, before = [], [], float("inf")
    few = PAIRS * classes.count()
    for turn in itertools.count():
        long = now.groupBy("list").agg((F.count(F.lit(1)) * F.count_if("short")).alias("pairs")).where(F.col("pairs") > SHORT * SHORT)
        left = long.agg(F.sum("pairs")).first()[0] or 0
        last = left <= few or turn >= TURNS - 1 and 2 * left > before
        before, long = left, long.select("list")
        short = now if last else now.join(long, "list", "left_anti")
        asked.append(keep(enough(_pairs(short, facts)) if turn == 0 else _by_smaller(short, percent)))
        if last:
            break
        hub = F.when(F.col("rest"), F.struct(F.col("n").alias("k"), F.col("alone").alias("k2"), "node", "n", "comp"))
        hub = hub.otherwise(F.struct(F.col("alone").alias("k"), F.col("n").alias("k2"), "node", "n", "comp"))
        hubs = now.join(long, "list").groupBy("list").agg(F.min(hub).alias("h"))
        spokes = now.join(hubs, "list").where("h.node <> node")
        spokes = keep(spokes.select(F.col("h.node").alias("hub"), F.col("h.n").alias("nh"), F.col("h.comp").alias("ch"), "node", "n", "alone", "comp").dropDuplicates(["hub", "node"]))
        now, linked = _apart(spokes, sets_of(spokes.select(F.col("hub").alias("a"), F.col("node").alias("b"))), percent)
        more.append(linked)
        clean(spark)
    pairs = reduce(DataFrame.union, asked).distinct().join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = reduce(DataFrame.union, [verified(keep(pairs)), *more])
    if more.count():
        labels = components(links.union(more))
    else:
        labels = first
    comps = classes.join(labels, "node", "left").select("sig", "rep", F.coalesce("label", "node").alias("comp"))
    least_id = comps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_sig = comps.join(least_id, "comp").select("sig", "component_id")
    out = known.join(by_sig, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
