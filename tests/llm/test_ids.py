"""Ids beyond 2**53, null and shared ones keep their value in every operator, and no row is lost."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import common, jaccard_join, kd_sharding, mixing, packing, quality, secrets, suffix_dedup, toxicity, weighted_sampling

BIG = 1152921504606846977
IDS = [BIG, BIG + 2, None, None, -(2**62) - 1, 7, 7, BIG + 4]


def text(k):
    return " ".join(f"word{k}x{j}" for j in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(k), "en", f"s{k % 2}", len(text(k)), "n") for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string").coalesce(1).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG, 1, 0), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(
    "run",
    [jaccard_join.op2, quality.op5, mixing.op6, kd_sharding.op7, weighted_sampling.op9, suffix_dedup.op10],
    ids=lambda f: f.__name__,
)
def test_rows_in_are_rows_out(docs, run):
    assert Counter(r.doc_id for r in run(docs).collect()) == Counter(IDS)


def test_packing_and_toxicity_and_fingerprint_and_redaction(docs, labels):
    pieces = packing.op3(docs).collect()
    assert {r.doc_id for r in pieces} == set(IDS)
    assert sum(r.doc_tokens for r in pieces if r.start == 0) == sum(r.length for r in pieces)
    assert Counter(r.doc_id for r in toxicity.op4(docs, labels).collect()) == Counter(IDS)
    scored = toxicity.score(docs, toxicity.train(docs, labels, toxicity.CATEGORIES))
    assert sorted(map(repr, scored.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert sorted(map(repr, weighted_sampling.fingerprint(docs).select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert sorted(map(repr, secrets.redact(docs, *secrets.model(docs)).collect())) == sorted(map(repr, docs.collect()))


def test_pipeline_loses_no_unlike_document(spark, docs, labels, tmp_path):
    docs.unionByName(docs.limit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = common.keep(stage(spark, got, str(tmp_path)))
        assert got.columns == docs.columns, name
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, text(k)) for k, i in enumerate(IDS))


def test_pipeline_on_empty_tables(spark, docs, labels, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_windows_hold_the_target_mixture(spark):
    rows = [(i, "a b c d e f g h " * (3 + i % 5), "xyz"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack(df, weights=(5, 2, 1), sequence=64, window=8, lane=2).collect()
    total, taken = Counter(), {}
    for r in out:
        total[r.source] += r.length
        taken.setdefault(r.sequence_id // 8, Counter())[r.source] += r.length
    used = Counter()
    for w in sorted(taken):  # until a queue runs dry, each window has its parts of the target to a token or two
        used.update(taken[w])
        if any(used[s] >= total[s] for s in "xyz"):
            break
        assert np.allclose([taken[w][s] for s in "xyz"], [512 * x / 8 for x in (5, 2, 1)], atol=2)
    assert w > 3


def test_verdict_of_divergence_against_brute_force(spark):
    rng = np.random.default_rng(3)
    usual = ["the", "and", "house", "river", "stone", "light", "green", "walks"]
    rows = [(i, " ".join(rng.choice(usual, 200, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])) + ".", "en") for i in range(40)]
    rows += [(100, "Q7! " * 150 + "END9 " * 60, "en"), (101, " ".join(f"zz{j}" for j in range(200)), "en"), (102, " ".join(rng.choice(usual[-2:], 200)), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import re

    tokens = {i: re.findall(r"[^\W\d_]+", t.lower()) for i, t, _ in rows}
    whole = Counter(w for t in tokens.values() for w in t)
    all_ = sum(whole.values())
    common_ = [w for w, n in whole.items() if n >= quality.COMMON_SHARE * all_]

    def js(p, q):
        p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
        m = (p + q) / 2
        part = lambda a: np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])) / 2
        return max(0.0, part(p) + part(q)) ** 0.5

    got = {r.doc_id: r for r in quality.op5(df).collect()}
    for i, t, _ in rows:
        n = len(t.split())
        c = Counter(tokens[i])
        held = [c[w] for w in common_]
        if n >= sum(held):
            want = js([*held, n - sum(held)], [*[whole[w] for w in common_], all_ - sum(whole[w] for w in common_)])
            assert got[i].word_distance == pytest.approx(want, abs=1e-5), i
    assert not got[101].kept and not got[102].kept and not got[100].kept


def test_likeness_of_fingerprints(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(120))) for i in range(6)] + [(9, None)]
    out = {r.doc_id: r for r in weighted_sampling.op9(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = [9, 5, 4, 3, 2, 1, 0]
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        assert out[a].near_next == weighted_sampling.likeness(out[a].fingerprint, out[b].fingerprint)
        assert out[a].near_edited == weighted_sampling.likeness(out[a].fingerprint, out[a].edited_fingerprint)


def test_a_cluster_needs_a_shared_folder():
    assert common.one_machine("local[4]") and common.one_machine("local")
    assert not common.one_machine("local-cluster[3,2,1024]") and not common.one_machine("spark://host:7077")
