"""Mixture-controlled packing by deficit round-robin over source queues.

Each source's documents form a queue of tokens. Every window (a number of sequences) takes from
each queue its share of tokens; what rounding leaves over is a deficit that the queue is owed in
the next window. When a queue runs dry, the others share its part. Documents are cut where a
window or sequence is full, so only the very last sequence can be short.

To run on many machines, the schedule is cut into lanes of whole windows. How far every queue has
come, and its deficit, at each lane's start follow from the totals by source, so lanes start with
the deficits that the lanes before left and fill their windows independently.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import chunks
from .common import keep, tidy
from .tokens import encoder

SEQUENCE = 1024
#: Sequences that a window holds: over each the mixture keeps its proportions.
WINDOW = 64
#: Windows that a lane, one task's group, holds: 4 MB of ids.
LANE = 32
MOST_LANES = 1 << 18
#: So many rows of queue starts at most are broadcast (about 50 bytes each).
MOST_BROADCAST = 200_000


def tokenize(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row: doc_id, source (as a string), n, ids (compressed), task, run (tokens of its
    source that the same task has seen before). Null text is empty; each document ends with id 0. Of
    equal texts one after the other, as a mixture repeats its rows, the first alone is tokenized."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack, task = encoder(), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        last, m, packed = None, 0, b""
        for b in batches:
            for lo, hi, _, _ in chunks(b.column("text")):
                n, ids, before = [], [], []
                part = b.slice(lo, hi - lo)
                for s, t in zip(part.column("source").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if (t or "") != last:
                        last = t or ""
                        x = encode(last) + b"\0\0"
                        m, packed = len(x) // 2, pack.compress(x)
                    ids.append(packed)
                    n.append(m)
                    before.append(seen.get(s, 0))
                    seen[s] = before[-1] + n[-1]
                own = [part.column("doc_id"), part.column("source")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(n), pa.int64()), pa.array(before, pa.int64())], ["doc_id", "source", "n", "ids", "task", "run"])

    return keep(rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, source string, n long, ids binary, task long, run long"))


def schedule(totals: np.ndarray, weights: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each queue has come at the start of each lane and at the end, the shares of each lane,
    and the deficits at its start. ``unit`` is the tokens of a lane."""
    s, total = len(totals), int(totals.sum())
    n = -(-total // unit) if total else 0
    upto, shares, owed = np.zeros((n + 1, s), np.int64), np.zeros((n, s)), np.zeros((n, s))
    ideal = np.zeros(s)
    for lane in range(n):
        room, before = min(unit, total - lane * unit), upto[lane]
        owed[lane] = ideal - before
        give = fluid(room, totals - ideal, weights)
        shares[lane] = give / max(give.sum(), 1e-9)
        ideal = np.minimum(ideal + give, totals)
        upto[lane + 1] = before + whole(ideal - before, totals - before, room)
    return upto, shares, owed


def fluid(room: float, left: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``room`` tokens split by weight, none above what its queue has left; a queue that runs dry leaves its part to the others."""
    give, rest = np.zeros(len(left)), float(room)
    open_ = left > 1e-9
    while rest > 1e-9 and open_.any():
        part = np.where(open_, weights, 0.0)
        part = part / part.sum() if part.sum() > 0 else open_ / open_.sum()
        got = np.minimum(rest * part, left - give)
        give += got
        rest -= got.sum()
        open_ = left - give > 1e-9
    return give


def whole(want: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """Whole numbers near ``want``, from 0 to ``most``, that sum to ``room``; the largest remainders go first."""
    take = np.clip(np.floor(want + 1e-9), 0, most).astype(np.int64)
    while (over := int(take.sum()) - room) != 0:
        step = 1 if over < 0 else -1
        free = (take < most) if over < 0 else (take > 0)
        order = np.argsort(-(want - take) * step, kind="stable")
        order = order[free[order]][: abs(over)]
        if not len(order):
            break
        take[order] += step
    return take


def fill(queues: list[np.ndarray], weights: np.ndarray, owed: np.ndarray, counts: np.ndarray, window: int, sequence: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (queue, row, start in the row, length, position in the lane) of one lane by deficit
    round-robin. ``queues``: the lengths of each queue's rows."""
    left, owed = counts.copy(), owed.copy()
    takes = []
    while left.sum() > 0:
        room = int(min(window, left.sum()))
        owed = owed + fluid(room, left, weights)
        take = whole(owed, left, room)
        owed, left = owed - take, left - take
        takes.append(take)
    if not takes:
        return []
    t = np.array(takes)
    starts = np.concatenate([[0], t.sum(1).cumsum()])[:-1, None] + np.concatenate([np.zeros((len(t), 1), np.int64), t.cumsum(1)[:, :-1]], 1)
    out = []
    for q, sizes in enumerate(queues):
        if not len(sizes):
            continue
        ends = sizes.cumsum()
        begins = ends - sizes
        q_ends = t[:, q].cumsum()
        q_begins = q_ends - t[:, q]
        # Sequence borders inside each window's part of this queue.
        cuts = [ends, q_ends]
        for w in np.flatnonzero(t[:, q]):
            first = starts[w, q]
            border = np.arange(-(-(first + 1) // sequence) * sequence, first + t[w, q], sequence)
            cuts.append(border - first + q_begins[w])
        points = np.unique(np.concatenate(cuts))
        points = points[points > 0]
        lo = np.concatenate([[0], points[:-1]])
        row, win = np.searchsorted(ends, lo, "right"), np.searchsorted(q_ends, lo, "right")
        for a, b, r, w in zip(lo, points, row, win, strict=True):
            out.append((q, int(r), int(a - begins[r]), int(b - a), int(starts[w, q] + a - q_begins[w])))
    return out


def pack(
    docs: DataFrame, *, weights: dict[str | None, float] | Sequence[float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW, lane: int = LANE,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset. Every token lies in exactly one piece; sequences are full but for the last.

    ``weights``: the target mixture, by source (0 if missing) or as a list that repeats along the
    sources by code point, null last; without it, sources keep their shares of all tokens. Every
    window holds its sources' parts of the target to a token, until a queue is dry; its part then goes
    to the others by weight. A null source is a source, others are taken as strings; null and empty
    texts are one token; very long texts are cut like any other; repeated rows are packed each; an
    empty table gives an empty result; other columns are not read. The number of sources, one row
    each on the driver, is bounded by the mixture's definition.
    """
    spark = docs.sparkSession
    rows = tokenize(docs, key=key, text=text, source=source)
    by_task = rows.groupBy("source", "task").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("source", "task", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("base"), "n")
    base = keep(base)
    sums = {r.source: r.n for r in base.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row per source
    names = sorted((s for s in sums if s is not None)) + [None] * (None in sums)
    totals = np.array([sums[s] for s in names], np.int64)
    if weights is None:
        weights = sums
    elif not isinstance(weights, dict):
        weights = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    share = np.array([float(weights.get(s, 0.0)) for s in names])
    unit = sequence * window * lane
    unit *= max(1, -(-int(totals.sum()) // (unit * MOST_LANES)))
    upto, _, owed = schedule(totals, share, unit)
    index = {s: i for i, s in enumerate(names)}
    small = base.count() <= MOST_BROADCAST
    starts = base.select(F.col("source").alias("s"), F.col("task").alias("t"), "base")
    placed = rows.join(F.broadcast(starts) if small else starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t"))).select(
        "doc_id", "source", "n", "ids", (F.col("base") + F.col("run")).alias("at")
    )
    kind = dict(rows.dtypes)["doc_id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut rows where a lane's part of their queue ends."""
        unzip, zip_ = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for i, (s, n, ids, at) in enumerate(zip(*(b.column(c).to_pylist() for c in ("source", "n", "ids", "at")), strict=True)):
                ends = upto[1:, index[s]]
                k, lo, whole_row = int(np.searchsorted(ends, at, "right")), at, b""
                while lo < at + n:
                    hi = min(at + n, int(ends[k]))
                    if hi > lo:
                        if hi - lo < n:
                            whole_row = whole_row or unzip.decompress(ids)
                        out.append((i, k, lo, lo - at, hi - lo, ids if hi - lo == n else zip_.compress(whole_row[2 * (lo - at) : 2 * (hi - at)])))
                    k, lo = k + 1, hi
            row, *cols = zip(*out, strict=True) if out else ((),) * 6
            own = [b.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "source", "n")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True))], ["doc_id", "source", "doc_tokens", "lane", "at", "start", "length", "ids"])

    def fill_lane(g: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        g = g.sort_by("at").combine_chunks()
        k = g["lane"][0].as_py()
        where = np.array([index[s] for s in g["source"].to_pylist()], np.int64)
        queues = [np.flatnonzero(where == i) for i in range(len(names))]
        length, start, first = g["length"].to_numpy(), g["start"].to_numpy(), k * (unit // sequence)
        rows, out, last, ids = [], [], None, b""
        for i, r, a, n, pos in fill([length[q] for q in queues], share, owed[k], upto[k + 1] - upto[k], sequence * window, sequence):
            row = int(queues[i][r])
            if row != last:
                last, ids = row, np.frombuffer(unzip.decompress(g["ids"][row].as_py()), "<u2").astype("<u4")
            rows.append(row)
            out.append((int(start[row]) + a, n, ids[a : a + n].tobytes(), first + pos // sequence, pos % sequence))
        own = [g[c].take(pa.array(rows, pa.int64())) for c in ("doc_id", "source", "doc_tokens")]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)]
        return pa.Table.from_arrays([*own, *cols], ["doc_id", "source", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"])

    lanes = placed.mapInArrow(tidy(deal), f"doc_id {kind}, source string, doc_tokens long, lane long, at long, start long, length long, ids binary")
    return lanes.groupBy("lane").applyInArrow(fill_lane, f"doc_id {kind}, source string, doc_tokens long, start long, length long, ids binary, sequence_id long, offset long")


def with_crc(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: The target mixture of the packing query, along the sources by code point.
WEIGHTS = (5, 2, 1)


def op3(docs: DataFrame) -> DataFrame:
    return with_crc(pack(docs, weights=WEIGHTS))
