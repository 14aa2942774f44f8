"""Toxicity by classifier chains: linear models in sequence, each fed the probabilities before it.

Training takes a bounded sample of labelled documents to the driver, as sets of words. Features
are words, their beginnings and a few marks of style; each model keeps those that go with its
category. A later model trains on out-of-fold probabilities of the earlier ones (folds by text, so
copies share a fold) and is given their full models' probabilities when it predicts. Scoring is
one pass without a shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import clean, give_back, tidy

#: The largest number of labelled documents to train on, taken by hash; all documents are scored.
MAX_TRAIN = 12_000
FOLDS = 5
#: A feature must be in so many training documents, and differ by so many standard errors.
LEAST_DOCS, LEAST_Z, MOST_FEATURES = 4, 4.0, 600
#: Buckets of the rough count of features, before the exact one.
BUCKETS = 1 << 23
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Words whose features a scorer remembers: about 4 MB a worker.
REMEMBER = 20_000
_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[#*$%&|<>!]")


def word_features(word: str) -> list[str]:
    return ["w:" + word, *("p:" + word[:k] for k in PREFIXES if len(word) > k)]


def text_parts(text: str | None) -> tuple[set[str], list[str]]:
    """Distinct lower-case words, and the marks of style that hold."""
    text = text or ""
    words = _LETTERS.findall(text)
    style = []
    if words:
        n = len(words)
        style += ["s:upper"] * (sum(map(str.isupper, words)) > 0.3 * n)
        style += ["s:symbols"] * (len(_SYMBOLS.findall(text)) > 0.2 * n)
        style += ["s:repeats"] * (n >= 50 and len(set(words)) < 0.3 * n)
        style += ["s:short"] * (n < 30)
    return set(map(str.lower, words)), style


@dataclass
class Linear:
    """A logistic model over named features and the probabilities of earlier categories."""

    names: list[str]
    weights: np.ndarray
    chain: np.ndarray
    bias: float


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last column of ``x`` (32-bit) is 1."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    blocks = [slice(lo, lo + 2048) for lo in range(0, len(x), 2048)]
    for _ in range(rounds):
        g, h = penalty * w, np.diag(penalty)
        for at in blocks:
            part = x[at].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            g += part.T @ (p - y[at])
            # The Hessian only steers; half of the precision will do.
            h += (x[at] * (p * (1 - p) + 1e-6)[:, None].astype(np.float32)).T @ x[at]
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)

    @classmethod
    def train(cls, bags: Callable[[], Iterable[Iterable[str]]], labels: np.ndarray, folds: np.ndarray, categories: Sequence[str]) -> Chain:
        """``bags``: gives the documents' features anew at each call; ``labels``: documents by categories, 0 or 1. A category with one class alone gets its prior."""
        # Most features are in one document: hashed counts keep these out of the exact ones.
        rough = np.zeros(BUCKETS, np.uint16)
        for bag in bags():
            at = np.unique(np.fromiter((hash(f) % BUCKETS for f in bag), np.int64))
            rough[at] += rough[at] < LEAST_DOCS
        counts: dict[str, int] = {}
        for bag in bags():
            for f in bag:
                if rough[hash(f) % BUCKETS] >= LEAST_DOCS:
                    counts[f] = counts.get(f, 0) + 1
        del rough
        for f in [f for f, n in counts.items() if n < LEAST_DOCS]:
            del counts[f]
        index = dict(zip(counts, range(len(counts)), strict=True))
        del counts
        names = list(index)
        # All documents' features one after another, 4 bytes each, and where each document ends.
        grown, ends = array("i"), [0]
        for bag in bags():
            grown.extend([index[f] for f in bag if f in index])
            ends.append(len(grown))
        del index
        n_docs, flat, upto = len(ends) - 1, np.frombuffer(grown, np.int32), np.array(ends, np.int64)

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(documents, features), a million at a time."""
            for lo in range(0, len(flat), 1 << 20):
                hi = min(len(flat), lo + (1 << 20))
                a, b = np.searchsorted(upto, lo, "right") - 1, np.searchsorted(upto, hi, "left")
                yield np.repeat(np.arange(a, b), np.diff(np.clip(upto[a : b + 1], lo, hi))), flat[lo:hi]

        def summed(by_doc: np.ndarray) -> np.ndarray:
            """For each feature, the sum of ``by_doc`` over the documents that have it; block by block."""
            out = np.zeros(len(names))
            for where, cols in blocks():
                out += np.bincount(cols, weights=by_doc[where], minlength=len(names))
            return out

        out, fed = cls(list(categories)), np.zeros((n_docs, 0))

        def model(rows: np.ndarray, y: np.ndarray, extra: np.ndarray) -> tuple[Linear, np.ndarray]:
            """A model trained on ``rows``, and the places of its features."""
            use = np.zeros(n_docs, bool)
            use[rows] = True
            n1, n0 = max(1, int(y[rows].sum())), max(1, int((1 - y[rows]).sum()))
            a = summed(use * y)
            b = summed(use.astype(float)) - a
            p = (a + b) / (n1 + n0)
            z = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
            z[(a + b < LEAST_DOCS) | (a + b >= n1 + n0)] = 0
            best = np.argsort(-np.abs(z), kind="stable")[:MOST_FEATURES]
            best = best[np.abs(z[best]) >= LEAST_Z]
            w = _fit(dense(best, extra, rows), y[rows])
            k = len(best)
            return Linear([names[i] for i in best], w[:k], w[k:-1], float(w[-1])), best

        def dense(best: np.ndarray, extra: np.ndarray, rows: np.ndarray) -> np.ndarray:
            place = np.full(len(names) + 1, -1, np.int32)
            place[best] = np.arange(len(best))
            line = np.full(n_docs, -1, np.int32)
            line[rows] = np.arange(len(rows))
            x = np.zeros((len(rows), len(best) + extra.shape[1] + 1), np.float32)
            for where, cols in blocks():
                i, j = line[where], place[cols]
                both = (i >= 0) & (j >= 0)
                x[i[both], j[both]] = 1
            x[:, len(best) : -1] = extra[rows]
            x[:, -1] = 1
            return x

        for c in range(len(categories)):
            y = labels[:, c].astype(float)
            if len(y) == 0 or y.min() == y.max():
                prior = float(y.mean()) if len(y) else 0.0
                out.models.append(Linear([], np.zeros(0), np.zeros(fed.shape[1]), float(_logit(np.array([prior]))[0])))
                fed = np.column_stack([fed, np.full(n_docs, _logit(np.array([prior]))[0])])
                continue
            oof = np.zeros(n_docs)
            for k in range(FOLDS):
                rows, held = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
                if not len(held):
                    continue
                if not len(rows) or y[rows].min() == y[rows].max():
                    oof[held] = _logit(np.array([y.mean()]))[0]
                    continue
                m, best = model(rows, y, fed)
                oof[held] = dense(best, fed, held) @ np.concatenate([m.weights, m.chain, [m.bias]])
            out.models.append(model(np.arange(n_docs), y, fed)[0])
            fed = np.column_stack([fed, np.clip(oof, -9, 9)])
        return out

    def scorer(self) -> Callable[[str | None], list[float]]:
        """A function from a text to a probability for each category; its word cache is bounded."""
        table: dict[str, list[tuple[int, float]]] = {}
        for i, m in enumerate(self.models):
            for f, w in zip(m.names, m.weights, strict=True):
                table.setdefault(f, []).append((i, float(w)))
        cache: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> list[float]:
            if len(cache) > REMEMBER:
                cache.clear()
            words, style = text_parts(text)
            found = {s for s in style if s in table}
            for w in words:
                hit = cache.get(w)
                if hit is None:
                    hit = cache[w] = tuple(f for f in word_features(w) if f in table)
                if hit:
                    found.update(hit)
            sums = [m.bias for m in self.models]
            for f in sorted(found):
                for i, w in table[f]:
                    sums[i] += w
            done: list[float] = []
            for i, m in enumerate(self.models):
                z = sums[i] + sum(float(a) * b for a, b in zip(m.chain, done, strict=True))
                done.append(max(-9.0, min(9.0, z)))
            return [1 / (1 + float(np.exp(-z))) for z in done]

        return score


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, int]], *, key: str = "doc_id", text: str = "text", most: int = MAX_TRAIN) -> Chain:
    """``categories``: name to (column of ``labels``, the value that means yes), in the chain's order.

    Labels with a null, and those without a document, are left out; of repeated labels the smallest
    row is used, of documents with one id the one whose text has the smallest hash. No labels at all
    train a chain that finds nothing.
    """
    cols = sorted({c for c, _ in categories.values()})
    picked = labels.select(F.col(key).alias("k"), *cols).dropna().groupBy("k").agg(F.min(F.struct(*cols)).alias("y")).select("k", "y.*").orderBy(F.xxhash64("k"), "k").limit(most)
    # At most ``most`` rows of some tens of bytes.
    both = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").to_pylist()
            parts, hashes = [text_parts(t) for t in texts], np.array([hash_text(t) for t in texts], np.uint64)
            words, style = [" ".join(sorted(p[0])) for p in parts], [" ".join(p[1]) for p in parts]
            own = [b.column(c) for c in ("k", *cols)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(hashes.view(np.int64)), pa.array((hashes % np.uint64(FOLDS)).astype(np.int32)), pa.array(words, pa.string()), pa.array(style, pa.string())], ["k", *cols, "h", "fold", "words", "style"])

    kind = dict(picked.dtypes)
    found = both.mapInArrow(tidy(bags), f"k {kind['k']}, {', '.join(f'{c} {kind[c]}' for c in cols)}, h long, fold int, words string, style string")
    got = found.groupBy("k", *cols).agg(F.min(F.struct("h", "fold", "words", "style")).alias("d")).select("k", *cols, "d.fold", "d.words", "d.style").toArrow()
    order = pc.sort_indices(got, [("k", "ascending")]).to_numpy()
    y = np.column_stack([(got[c].to_numpy()[order] == v).astype(int) for c, v in categories.values()])

    def sets() -> Iterator[list[str]]:
        for i in order:
            words, style = got["words"][i].as_py(), got["style"][i].as_py()
            yield sorted({f for w in words.split() for f in word_features(w)} | set(style.split()))

    # The JVM stands idle while Python trains: what it has gathered so far need not stay beside the training matrix.
    clean(docs.sparkSession)
    chain = Chain.train(sets, y, got["fold"].to_numpy()[order], list(categories))
    del got, y
    give_back()
    clean(docs.sparkSession)
    return chain


def hash_text(text: str | None) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))


def score(docs: DataFrame, chain: Chain, *, text: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability column for each category, which takes the place of one of that
    name. Null and empty texts get the models' biases; all rows stay, repeated ones too."""
    names = [prefix + c for c in chain.categories]
    base = docs.drop(*[n for n in names if n in docs.columns])
    columns = [*base.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = chain.scorer()
        for b in batches:
            p = [f(t.as_py()) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[i] for x in p], pa.float64()) for i in range(len(names)))], columns)

    return base.mapInArrow(tidy(run), StructType([*base.schema, *(StructField(n, DoubleType()) for n in names)]))


#: What the labels table names, in the chain's order; the toxic model sees the chance of junk.
CATEGORIES = {"junk": ("quality", 0), "toxic": ("toxic", 1)}
LIMIT = 0.5


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    chain = train(docs, labels, CATEGORIES)
    out = score(docs.select("doc_id", "text"), chain)
    return out.select("doc_id", F.round("p_junk", 6).alias("p_junk"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") >= LIMIT).alias("toxic"))
