"""Removal of long repeated byte strings by a depth-limited radix sort of sampled suffixes.

Suffixes matter only through their first ``span`` bytes, so they are ordered by most significant
digits until groups are single or ``span`` deep:

1. Every ``span``-byte window elects the position in it whose next ``DIGIT`` bytes hash smallest.
   Equal windows elect alike, so it is enough to sort the elected suffixes, one in about 75. The first
   digit is those bytes; suffixes alone in their group hold no repeat and leave.
2. The second digit is all bytes that the windows electing the position cover. Equal groups are
   repeats as a whole, however large; they need one aggregate, not pairs.
3. In groups of the first digit that the second split in several, each member that is alone and one of
   each equal group go on. Their windows are cut in bands of ``BANDS[0]`` neighbours: the digit is what
   all windows of a band have in common, then all that they cover. Bands alone with their digit leave,
   those equal as a whole are repeats, and the rest are split by the next width, down to single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import chunks, mix, powers, prefix_sums
from .common import keep, tidy

SPAN, DIGIT = 200, 48
#: Windows in a band at each further digit; the last must be 1.
BANDS = (39, 8, 1)
#: Longer texts are searched in parts that overlap by a window; positions then fit in 24 bits.
PART = 1 << 22
#: Ids of so many documents at most are broadcast (64 MB) to spare the others a shuffle.
MOST_BROADCAST = 1_000_000
_U = np.uint64
_INDEX = _U((1 << 24) - 1)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest value of each window of ``w`` values."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, _U)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def elect(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, digit: int = DIGIT) -> tuple[np.ndarray, ...]:
    """Elected suffixes of the texts in ``data``: text, first window, number of windows, position, first digit."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, _U),)
    if len(data) < span:
        return none
    with np.errstate(over="ignore"):
        s = prefix_sums(data)
        _, inverse = powers(len(data) + 1)
        h = mix((s[digit:] - s[:-digit]) * inverse[: len(s) - digit])
    packed = (h & ~_INDEX) | np.arange(len(h), dtype=_U)
    least = _least(packed, span - digit + 1)
    at = (least & _INDEX).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
    starts = np.arange(len(at))
    valid = starts + span <= ends
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (ends[1:] != ends[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    # The number of windows: valid starts from here to the next run.
    total = np.concatenate([[0], np.cumsum(valid)])
    count = total[np.concatenate([first[1:], [len(valid)]])] - total[first]
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first, count, at[first], h[at[first]]


def _parts(column: pa.Array, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, offset of each text part in its text, bytes, offsets)."""
    for lo, hi, data, offsets in chunks(column):
        if len(data) <= PART:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), data, offsets
        else:
            for i in range(hi - lo):
                body = data[offsets[i] : offsets[i + 1]]
                for at in range(0, max(1, len(body) - span + 1), PART):
                    part = body[at : at + PART + span - 1]
                    yield np.array([lo + i]), np.array([at]), part, np.array([0, len(part)])


_SUFFIXES = "doc_id long, th long, lo int, n short, p short, kh long, ch long"


def _suffixes(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column("doc_id"), b.column("th")
            for rows, shift, data, offsets in _parts(b.column("text"), span):
                text, lo, n, at, digit = elect(data, offsets, span)
                if not len(lo):
                    continue
                view = memoryview(data)
                context = [xxhash.xxh3_64_intdigest(view[a : a + k + span - 1], p - a) for a, k, p in zip(lo.tolist(), n.tolist(), at.tolist(), strict=True)]
                row = pa.array(rows[text])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), hashes.take(row), pa.array((lo - offsets[text] + shift[text]).astype(np.int32)), pa.array(n.astype(np.int16)),
                     pa.array((at - lo).astype(np.int16)), pa.array(digit.view(np.int64)), pa.array(np.array(context, _U).view(np.int64))],
                    ["doc_id", "th", "lo", "n", "p", "kh", "ch"],
                )

    return tidy(run)


_BODY = "doc_id long, th long, lo int, n short, p short, kh long, many byte, body binary"


def _bodies(span: int):
    """Each task of a text with the bytes that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tasks, hashes = b.column("doc_id").to_pylist(), b.column("tasks"), b.column("th").to_pylist()
            for row0, _, data, offsets in chunks(b.column("text")):
                view, out = memoryview(data), []
                for row, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), row0):
                    for t in tasks[row].as_py():
                        end = x + t["lo"] + t["n"] + span - 1
                        if end <= y:
                            out.append((ids[row], hashes[row], t["lo"], t["n"], t["p"], t["kh"], t["many"], view[x + t["lo"] : end].tobytes()))
                if out:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int8(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "th", "lo", "n", "p", "kh", "many", "body"])

    return tidy(run)


_BAND = "id long, s short, n short, many byte, core long, ctx long"


def _bands(span: int, digit: int, width: int):
    """Bands of the windows ``s`` to ``s + n - 1`` of a body: hashes of what the windows share and of what they cover.

    Bands are counted from the elected position ``p``, so equal windows lie in bands alike.
    """
    mask = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, s, n, many, p, kh, body in zip(*(b.column(c).to_pylist() for c in ("id", "s", "n", "many", "p", "kh", "body")), strict=True):
                view, end = memoryview(body), s + n
                while s < end:
                    band = (p - s) // width
                    near = band * width
                    far = min(near + width - 1, span - digit)
                    upto = min(end, p - near + 1)
                    core = xxhash.xxh3_64_intdigest(view[p - near : p - far + span], (kh + band * 0x9E3779B97F4A7C15) & mask)
                    ctx = xxhash.xxh3_64_intdigest(view[s : upto - 1 + span], (core + p - s) & mask)
                    out.append((i, s, upto - s, many, core, ctx))
                    s = upto
            if out:
                i, s, n, many, core, ctx = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int64()), pa.array(s, pa.int16()), pa.array(n, pa.int16()), pa.array(many, pa.int8()), pa.array(np.array(core, _U).view(np.int64)), pa.array(np.array(ctx, _U).view(np.int64))],
                    ["id", "s", "n", "many", "core", "ctx"],
                )

    return tidy(run)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cuts, out, row = b.column("cuts"), [], 0
        for _, _, data, offsets in chunks(b.column("text")):
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                body = data[x:y]
                edge = np.zeros(len(body) + 1, np.int64)
                for c in cuts[row].as_py() or ():
                    edge[c["a"]] += 1
                    edge[c["b"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(body), int(gone.sum()), spans, body[~gone].tobytes()))
                row += 1
        n, r, k, kept = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, *, span: int = SPAN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept (binary): every byte covered by a
    ``span``-byte string that also starts elsewhere, in this or another row, is removed.

    Null texts are empty; texts shorter than ``span`` stay; repeated rows repeat each other; an empty
    table gives an empty result; other columns are not read. Equality is by pairs of 64-bit hashes.
    Rows are told apart by id and a 64-bit hash of their text, so ids may be null or shared.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    suffixes = keep(rows.mapInArrow(_suffixes(span), _SUFFIXES))
    # First digit: groups of one leave.
    # Frequent digits are kept as tables, so both sides of a join are plain shuffles, of which Spark can split a large group.
    digits = keep(suffixes.groupBy("kh").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("kh"))
    grouped = keep(suffixes.join(digits, "kh", "left_semi"))
    # Second digit.
    contexts = grouped.groupBy("kh", "ch").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "lo", "n", "p")).alias("r"))
    contexts = keep(contexts)
    several = keep(contexts.groupBy("kh").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("kh"))
    equal = contexts.where("c > 1").select("kh", "ch")
    end = (F.col("lo") + F.col("n") + F.lit(span - 1)).cast("int")
    whole = grouped.join(equal, ["kh", "ch"], "left_semi").select("doc_id", "th", F.col("lo").alias("a"), end.alias("b"))
    # Further digits for the groups that the second split.
    split = contexts.join(several, "kh", "left_semi").select("kh", (F.col("c") > 1).cast("tinyint").alias("many"), "r.doc_id", "r.th", "r.lo", "r.n", "r.p")
    tasks = keep(split.groupBy("doc_id", "th").agg(F.collect_list(F.struct("kh", "lo", "n", "p", "many")).alias("tasks")))
    listed = _only(rows, tasks).join(tasks, _same(rows, tasks)).select(rows["doc_id"], rows["th"], "text", "tasks")
    bodies = keep(listed.mapInArrow(_bodies(span), _BODY).withColumn("id", F.monotonically_increasing_id()))
    todo = bodies.select("id", F.lit(0).cast("short").alias("s"), "n", "many", "p", "kh", "body")
    for width in BANDS:
        bands = keep(todo.mapInArrow(_bands(span, DIGIT, width), _BAND))
        same = bands.groupBy("core", "ctx").agg(F.sum(F.col("many") + 1).alias("c"), F.min(F.struct("id", "s", "n")).alias("r"))
        same = keep(same)
        equal = same.where("c > 1").select("core", "ctx")
        found = bands.where("many = 0").join(equal, ["core", "ctx"], "left_semi").join(bodies.select("id", "doc_id", "th", "lo"), "id")
        at = F.col("lo") + F.col("s")
        whole = whole.unionByName(found.select("doc_id", "th", at.cast("int").alias("a"), (at + F.col("n") + F.lit(span - 1)).cast("int").alias("b")))
        if width > 1:
            several = same.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("core")
            on = same.join(several, "core", "left_semi").select("r.id", "r.s", "r.n", (F.col("c") > 1).cast("tinyint").alias("many"))
            todo = on.join(bodies.select("id", "p", "kh", "body"), "id").select("id", "s", "n", "many", "p", "kh", "body")
    cuts = keep(whole.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("cuts")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    if _small(cuts):
        touched = F.broadcast(cuts.select("doc_id", "th"))
        hit = rows.join(touched, _same(rows, touched), "left_semi")
        rest = rows.join(touched, _same(rows, touched), "left_anti")
        cut = hit.join(cuts, _same(hit, cuts)).select(hit["doc_id"], "text", "cuts").mapInArrow(tidy(_cut), schema)
        raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
        return cut.unionByName(rest.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), raw.alias("kept")))
    return rows.join(cuts, _same(rows, cuts), "left").select(rows["doc_id"], "text", "cuts").mapInArrow(tidy(_cut), schema)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _small(table: DataFrame) -> bool:
    return table.count() <= MOST_BROADCAST


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without those that ``wanted`` lacks, where its ids are few enough to tell before the shuffle."""
    if not _small(wanted):
        return rows
    few = F.broadcast(wanted.select("doc_id", "th"))
    return rows.join(few, _same(rows, few), "left_semi")


def op10(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
