"""Document fingerprints by consistent weighted sampling.

Each sample draws, for every weighted term, two gamma variates and a uniform one that depend on
the term alone, and keeps the term and quantised weight with the smallest key. Two texts agree in
a sample with a chance equal to their generalised Jaccard similarity: the sum of the smaller over
the sum of the larger weights (here: word counts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .bytetext import chunks, word_hashes
from .common import tidy

SAMPLES = 128
#: Bytes of text that are fingerprinted together, and terms whose keys are held at a time (50 MB at most).
CHUNK, TERMS = 1 << 19, 1 << 16
_U, _H = np.uint32, np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit numbers, in place."""
    x ^= x >> _U(16)
    x *= _U(0x85EBCA6B)
    x ^= x >> _U(13)
    x *= _U(0xC2B2AE35)
    x ^= x >> _U(16)
    return x


def _uniform(x: np.ndarray, bits: int = 32) -> np.ndarray:
    """Numbers between 0 and 1, both left out."""
    u = x.astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-bits)
    return np.minimum(u, np.float32(1 - 2.0**-24), out=u)


class Sampler:
    """Fingerprints texts: keys and marks of weighted terms, and the smallest key's mark for each sample."""

    def __init__(self, samples: int = SAMPLES, seed: int = 1) -> None:
        self.samples = samples
        grid = np.arange(4 * samples, dtype=_U).reshape(4, samples) + _U(seed * 1_000_003 & 0xFFFFFFFF)
        with np.errstate(over="ignore"):
            self.salt = _mix(grid * _U(0x9E3779B1) + _U(1))

    def draws(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms (64-bit hashes and counts): key and mark in each sample."""
        keys, marks = np.empty((len(h), self.samples), np.float32), np.empty((len(h), self.samples), np.uint16)
        for lo in range(0, len(h), 256):
            self._fill(h[lo : lo + 256], n[lo : lo + 256], keys[lo : lo + 256], marks[lo : lo + 256])
        return keys, marks

    def _fill(self, h: np.ndarray, n: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> None:
        low, high = (h & _H(0xFFFFFFFF)).astype(_U)[:, None], (h >> _H(32)).astype(_U)[:, None]

        def draw(j: int) -> np.ndarray:
            """32 bits for each term and sample."""
            x = low ^ self.salt[j]
            x *= _U(0xCC9E2D51)
            x ^= high
            return _mix(x)

        with np.errstate(over="ignore"):
            # Minus the logarithm of the product of two uniforms is a gamma variate of shape 2.
            c = _uniform(draw(0))
            c *= _uniform(draw(1))
            np.log(c, out=c)
            np.negative(c, out=c)
            both = draw(2)
            r = _uniform(both >> _U(16), 16)
            r *= _uniform(both & _U(0xFFFF), 16)
            np.log(r, out=r)  # minus the other variate
            beta = _uniform(draw(3))
            # A count of 1 has logarithm 0, and its quantum t is 0.
            marks[:] = (h * _H(0x9FB21C651E98DF25) >> _H(48)).astype(np.uint16)[:, None]
            more = np.flatnonzero(n > 1)
            if len(more):
                t = np.floor(np.log(n[more].astype(np.float32))[:, None] / -r[more] + beta[more])
                marks[more] = ((h[more, None] + t.astype(_H) * _H(0xD6E8FEB86659FD93)) * _H(0x9FB21C651E98DF25) >> _H(48)).astype(np.uint16)
                beta[more] -= t
            # log c - r (t - beta) - r
            np.subtract(np.float32(1), beta, out=beta)
            beta *= r
            np.add(beta, np.log(c, out=c), out=keys)

    def least(self, keys: np.ndarray, marks: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The mark of the smallest key of ``rows`` in each sample."""
        return marks[rows[keys[rows].argmin(0)], np.arange(self.samples)]

    def long(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Marks of a text with many terms, some at a time."""
        best, mark, cols = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint16), np.arange(self.samples)
        for lo in range(0, len(h), TERMS):
            k, m = self.draws(h[lo : lo + TERMS], n[lo : lo + TERMS])
            at = k.argmin(0)
            mark, best = np.where(k[at, cols] < best, m[at, cols], mark), np.minimum(k[at, cols], best)
        return mark

    def some(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> list[str]:
        """Fingerprints of documents as (hashes, counts), whose common terms are drawn once."""
        h, n = (np.concatenate(x) for x in zip(*docs, strict=True))
        with np.errstate(over="ignore"):
            _, one, row = np.unique(h + n.astype(_H) * _H(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
        if len(one) > TERMS:
            half = len(docs) // 2
            return self.some(docs[:half]) + self.some(docs[half:]) if half else [_hex(self.long(h, n))]
        keys, marks = self.draws(h[one], n[one])
        ends = np.cumsum([0] + [len(x) for x, _ in docs]).tolist()
        return [_hex(self.least(keys, marks, row[a:b])) if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def all(self, texts: pa.Array) -> list[str]:
        """For each text hex digits, four a sample; empty for a null text and one without words."""
        out: list[str] = []
        for _, _, data, offsets in chunks(texts, CHUNK):
            words, first = word_hashes(data, offsets, fold_case=False)
            out += self.some([np.unique(words[a:b], return_counts=True) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
        return out

    def __call__(self, text: str) -> str:
        return self.all(pa.array([text], pa.large_string()))[0]


def _hex(marks: np.ndarray) -> str:
    return marks.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal samples; two empty fingerprints are alike, an empty one is unlike any other."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def fingerprint(docs: DataFrame, *, text: str = "text", out: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """``docs`` with column ``out``, which takes the place of one of that name; null texts count as empty. No shuffle."""
    base = docs.drop(out)
    names = [*base.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sampler(samples)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.all(b.column(text)), pa.string())], names)

    return base.mapInArrow(tidy(run), StructType([*base.schema, StructField(out, StringType())]))


#: Characters of text that a block of consecutive documents holds, about.
BLOCK_CHARS = 8_000_000


def op9(docs: DataFrame) -> DataFrame:
    """Each text, its edited text (its end overwritten by the start of the next document) and their likeness.

    Documents are dealt into blocks of consecutive ids by quantiles of the id; the first document of
    each next block is also given to the block before, so a block has all its neighbours and no window
    spans the table. Equal ids sort by text; a null id comes last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text")).alias("c"), F.count(F.lit(1)).alias("n")).first()
    n_blocks = max(1, min(int((total["c"] or 0) // BLOCK_CHARS), 100_000))
    cuts = sorted({int(x) for x in rows.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n_blocks for i in range(1, n_blocks)], 0.2 / n_blocks)}) if n_blocks > 1 else []
    # Block of an id: the number of cuts below or at it, so blocks descend with ids; a null id is below all.
    block = F.lit(0)
    if cuts:
        bounds = np.array(cuts)

        @F.arrow_udf("int")
        def place(ids: pa.Array) -> pa.Array:
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            return pa.array(np.where(known, 1 + np.searchsorted(bounds, ids.fill_null(0).to_numpy(), "right"), 0).astype(np.int32))

        block = place("doc_id")
    dealt = rows.withColumn("block", block)
    # One id a block: its largest.
    heads = {r.block: r.top for r in dealt.groupBy("block").agg(F.max("doc_id").alias("top")).collect()}
    if not heads:
        return _compare(dealt.withColumn("lead", F.lit(0)), 1)
    down = sorted(heads, reverse=True)
    before = {b: down[i - 1] for i, b in enumerate(down)}  # the first block's head follows the last block
    where = [(heads[b], int(b), int(before[b])) for b in down]
    leads = docs.sparkSession.createDataFrame(where, "top long, of int, to int")
    extra = rows.join(F.broadcast(leads), F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("to").agg(F.min("text").alias("text"), F.first("top").alias("doc_id"))
    both = dealt.withColumn("lead", F.lit(0)).unionByName(extra.select("doc_id", "text", F.col("to").alias("block"), F.lit(1).alias("lead")))
    return _compare(both, len(down))


def _compare(both: DataFrame, n_blocks: int) -> DataFrame:
    parts = max(1, min(4 * n_blocks, 100_000))
    flow = both.repartition(parts, "block").sortWithinPartitions("block", "lead", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, last, own = Sampler(), None, ""  # last: the row that awaits its neighbour; own: its fingerprint
        for b in batches:
            blocks, leads, ids, texts = (b.column(c) for c in ("block", "lead", "doc_id", "text"))
            for lo, hi, _, _ in chunks(texts, CHUNK):
                rows = list(zip(*(c.slice(lo, hi - lo).to_pylist() for c in (blocks, leads, ids, texts)), strict=True))
                before = [last, *rows[:-1]]
                joined = [x is not None and x[0] == y[0] and not x[1] for x, y in zip(before, rows, strict=True)]
                edited = [x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2] if j else None for x, y, j in zip(before, rows, joined, strict=True)]
                # Each text after the edited text that it goes into: most of their terms are the same.
                prints = s.all(pa.array([t for e, r in zip(edited, rows, strict=True) for t in (e, r[3])], pa.large_string()))
                out = []
                for x, y, e, its, following in zip(before, rows, edited, prints[::2], prints[1::2], strict=True):
                    if e is not None:
                        sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((x[2], len(x[3]), sha, own, its, likeness(own, its), likeness(own, following)))
                    own = following
                last = rows[-1]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(_KINDS), _KINDS, strict=True)], _NAMES)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return flow.select("block", "lead", "doc_id", "text").mapInArrow(tidy(run), schema)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
