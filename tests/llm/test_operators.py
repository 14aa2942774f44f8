"""Corpus operators against brute force, on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import chat_format, jaccard_join, kd_sharding, mixing, packing, quality, secrets, suffix_dedup, toxicity, weighted_sampling

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts():
    rng = np.random.default_rng(5)
    make = lambda n: " ".join(rng.choice(WORDS, n))
    base = make(150)
    out = [None, "", " \n\t", "one", "two words", base, base, base + " tail", base[:-20], make(3000)]
    out += [make(int(n)) for n in rng.integers(1, 120, 20)]
    out += [make(30) + " " + base[:260] + " " + make(20), "x" * 700, "é" * 300, "line\nline\nother\nline"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "b", None][i % 4], None if t is None else len(t), i, i) for i, t in enumerate(texts())]
    rows += [rows[5], rows[12]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, size long").cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def linked_by_brute_force(docs, size, percent):
    sets = {}
    for i, t in rows_of(docs):
        w = words(t.lower())
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def linked(docs, size, percent):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, size=size, percent=percent).collect()}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, empty, size, percent):
    assert linked(docs, size, percent) == linked_by_brute_force(docs, size, percent)
    assert jaccard_join.near_duplicates(empty, size=size, percent=percent).count() == 0


@pytest.mark.parametrize(("short", "turns"), [(1, 6), (3, 2)])
def test_jaccard_join_goes_by_hubs(spark, monkeypatch, short, turns):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "TURNS", turns)
    rng = np.random.default_rng(17)
    made = []
    for _ in range(3):
        base = [str(x) for x in rng.integers(0, 9000, 160)]
        edits = [(int(at), str(x)) for at, x in zip(rng.integers(0, 160, 8), rng.integers(0, 9000, 8), strict=True)]
        for _ in range(60):  # near copies around the limit: own edits, edits that several share, cut ends
            t = list(base)
            for at, x in [edits[int(j)] for j in rng.integers(0, 8, rng.integers(0, 5))]:
                t[at] = x
            for at in rng.integers(0, 160, rng.integers(0, 6)):
                t[at] = str(rng.integers(9000, 99000))
            made.append(" ".join(t[: 160 - int(rng.integers(0, 20)) * int(rng.integers(0, 2))]))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    want = linked_by_brute_force(frame, 3, 90)
    assert 3 < len({c for _, c in want.values()}) < len(made)
    assert linked(frame, 3, 90) == want


def test_jaccard_join_meets_few_pairs_of_near_copies_that_do_not_link(spark, monkeypatch):
    met, apart = [], jaccard_join._apart

    def counted(*args):
        lists, links = apart(*args)
        short = F.count_if("short") if "short" in lists.columns else F.count(F.lit(1))
        met.append(lists.groupBy("list").agg((F.count(F.lit(1)) * short).alias("k")).agg(F.sum("k")).first()[0] or 0)
        return lists, links

    monkeypatch.setattr(jaccard_join, "_apart", counted)
    monkeypatch.setattr(jaccard_join, "SHORT", 8)
    rng = np.random.default_rng(41)
    base, made = [f"w{j}" for j in range(150)], []
    for i in range(160):  # four to seven edits of their own each, so that few link, and edits that some share
        t = list(base)
        for at in rng.choice(150, rng.integers(4, 8), replace=False):
            t[at] = f"e{i}x{at}" if rng.random() < 0.8 else f"s{at // 30}"
        made.append(" ".join(t))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    assert linked(frame, 5, 80) == linked_by_brute_force(frame, 5, 80)
    assert met and sum(met) < 5 * len(made), met


@pytest.mark.parametrize("percent", [90, 80])
def test_jaccard_join_of_texts_that_hold_others(spark, percent):
    rng = np.random.default_rng(29)
    made = []
    for i in range(240):  # a text, and the same with a footer, a heading or a passage more, exactly at the limit or just above
        n = int(rng.integers(3, 10)) * 10
        more = n * 100 // percent - n - int(rng.integers(0, 2))
        body = [f"w{i}x{j}" for j in range(n + 2)]
        extra = [f"e{i}x{j}" for j in range(more)]
        longer = body + extra if i % 3 == 0 else extra + body if i % 3 == 1 else body[: n // 2] + extra[:-2] + body[n // 2 :]
        made += [" ".join(body), " ".join(longer)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    want = linked_by_brute_force(frame, 3, percent)
    assert sum(i != c for i, (_, c) in want.items()) >= 150
    assert linked(frame, 3, percent) == want


def test_packing(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out = packing.op3(docs).collect()
    by, seqs = {}, {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, t in rows_of(docs):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        covered = Counter()
        for r in by[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            covered.update(range(r.start, r.start + r.length))
        copies = 2 if i in (5, 12) else 1
        assert covered == {k: copies for k in range(len(ids))}
    for s, parts in seqs.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or s == max(seqs)
    assert packing.op3(empty).count() == 0


def test_packing_keeps_proportions():
    totals, share = np.array([50_000, 30_000, 20_000]), np.array([0.5, 0.3, 0.2])
    upto, shares, owed = packing.schedule(totals, share, 10_240)
    assert (upto[-1] == totals).all() and (np.diff(upto, axis=0) >= 0).all()
    assert np.abs(upto[1:-1] - np.arange(1, len(upto) - 1)[:, None] * 10_240 * share).max() <= 2


def test_mixing(docs, empty):
    out = mixing.mix(docs).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in out:
        taken[r.source] += r.size * r.copies
        size[r.source] += r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= 2
    assert all(target[s] <= 2 * size[s] + 1e-6 for s in size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    biggest = max(r.size for r in out)
    assert all(abs(taken[s] - target[s]) <= biggest for s in size)
    again = mixing.resample(docs)
    assert again.columns == docs.columns
    assert again.count() == sum(r.copies for r in out)
    assert mixing.mix(empty).count() == 0 and mixing.resample(empty).count() == 0


def test_budgets_are_shared_again():
    got = mixing.budgets({"a": 10, "b": 100, None: 100}, (5, 2, 1), 1.5, 2)
    assert got["a"] == 20 and got["b"] == pytest.approx(295 * 2 / 3) or got["b"] == 200
    assert sum(got.values()) == pytest.approx(315)
    assert mixing.budgets({"a": 10, "b": 100}, (0, 1), 1.5, 2) == {"a": 0.0, "b": pytest.approx(165)}
    assert mixing.budgets({"a": 10, "b": 100}, (0, 0), 1.5, 2) == {"a": 0.0, "b": 0.0}


def test_sharding(docs, empty):
    out = kd_sharding.shard(docs, n_shards=4).collect()
    slots, load = {}, Counter()
    sizes = {i: len(t.encode()) + 1 for i, t in rows_of(docs)}
    crc = {i: zlib.crc32(t.encode()) for i, t in rows_of(docs)}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
        assert r.size == sizes[r.doc_id] and r.text_crc32 == crc[r.doc_id]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert max(load.values()) <= sum(load.values()) / 4 + max(sizes.values())
    assert kd_sharding.shard(empty, n_shards=4).count() == 0


def test_sharding_of_repeated_rows_and_long_names(spark):
    rows = [(1, "first " * 20, None, "https://example.org/a")] * 40 + [(2, "second " * 20, "en", "https://example.org/b")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    load = Counter()
    for r in kd_sharding.shard(df, n_shards=8).collect():
        load[r.shard] += r.size
    assert set(load) == set(range(8)) and max(load.values()) <= sum(load.values()) / 8 + 141
    kinds = [(i, f"text number {i} of many", "en", f"common_crawl_{'ab'[i % 2]}") for i in range(200)]  # split by source: all else is alike
    kinds = spark.createDataFrame(kinds, df.schema)
    got = kd_sharding.shard(kinds.withColumn("text", F.lpad("text", 30, "x")), n_shards=2).collect()
    assert {(r.shard, r.doc_id % 2) for r in got} == {(0, 0), (1, 1)}


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi"), (1, 2, "assistant", "a\\b ### x </turn>"), (1, 1, "user", None), (1, 3, "assistant", "\\h"), (2, 0, None, "r\n"), (2, None, "as\nk:", "\\+"), (None, 0, "assistant", "end"), (1, 3, "assistant", "\\h")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.op8(df).collect()}
    by = {}
    for c, t, role, text in [*rows, (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_quality(docs, empty):
    for r in quality.op5(docs).collect():
        t = dict(rows_of(docs))[r.doc_id]
        w = words(t)
        c = Counter(zip(w, w[1:], w[2:]))
        rep = {k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality.op5(empty).count() == 0


def test_weighted_sampling(docs, empty):
    out = weighted_sampling.op9(docs).collect()
    rows = sorted(rows_of(docs), key=lambda x: (-x[0], x[1]))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    prints = {}
    for r in out:
        assert prints.setdefault(dict(rows)[r.doc_id], r.fingerprint) == r.fingerprint
    assert weighted_sampling.op9(empty).count() == 0


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(1)
    s = weighted_sampling.Sampler(samples=512)
    for _ in range(5):
        a, b = " ".join(rng.choice(WORDS, 60)), " ".join(rng.choice(WORDS[:8], 90))
        x, y = Counter(a.split()), Counter(b.split())
        assert weighted_sampling.likeness(s(a), s(b)) == pytest.approx(sum((x & y).values()) / sum((x | y).values()), abs=0.1)


def cut_by_brute_force(docs):
    raw = [(i, t.encode()) for i, t in rows_of(docs)]
    c = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if c[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return want


def cut(docs):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op10(docs).collect())


def test_suffix_dedup(docs, empty):
    assert cut(docs) == cut_by_brute_force(docs)
    assert suffix_dedup.op10(empty).count() == 0


@pytest.mark.parametrize("most", [None, 0])
def test_suffix_dedup_of_null_and_shared_ids(spark, monkeypatch, most):
    if most is not None:  # by shuffles instead of broadcasts
        monkeypatch.setattr(suffix_dedup, "MOST_BROADCAST", most)
    rng = np.random.default_rng(11)
    passage = [" ".join(rng.choice(WORDS, 60)) for _ in range(3)]
    rows = [([None, 7, 7, -(2**62)][i % 4], f"{i} head {passage[i % 3][: 300 - 9 * i]} tail {i} " + " ".join(rng.choice(WORDS, 20))) for i in range(16)]
    rows += [rows[1], rows[0], (None, None), (None, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = cut_by_brute_force(df)
    assert any(removed for _, _, removed, _, _ in want)
    assert cut(df) == want


def test_toxicity(spark, empty):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = " ".join(rng.choice(WORDS, 40))
        rows.append((i, (t + " grumble" + rng.choice(["y", "s", "er"])) if toxic else t if i % 50 else None, i))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, p_toxic long")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.toxic for r in toxicity.op4(df, lab).collect()}
    held = [i for i in out if i >= 300]
    assert sum(out[i] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert toxicity.op4(empty, lab.limit(0)).count() == 0
    assert not any(r.toxic for r in toxicity.op4(df, lab.limit(0)).collect())


def test_secrets(spark, empty):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'alpha token = "{key}" omega', 9), (2, f"commit {key} fixed it", 9), (3, None, 9), (4, "", 9), (5, "see https://www.example.com/path/to/some_file_name2024.html now", 9), (6, f'x token = "{key}" and card 4736962573099581', 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, candidate long")
    trees, words_ = secrets.model(df)
    found = {(r.doc_id, r.candidate) for r in secrets.scan(df, trees, words_).collect() if r.p >= secrets.LIMIT}
    assert found == {(1, key), (6, key)}
    clean = {r.doc_id: r.text for r in secrets.redact(df, trees, words_).collect()}
    assert clean == {1: 'alpha token = "[SECRET]" omega', 2: rows[1][1], 3: None, 4: "", 5: rows[4][1], 6: 'x token = "[SECRET]" and card 4736962573099581'}
    assert secrets.scan(empty, trees, words_).count() == 0


def test_forest_on_held_out_findings(spark):
    words_ = F.split(F.lit(secrets.WORDS), " ")
    all_ = secrets.labelled_findings(spark, 2000).withColumn("k", F.monotonically_increasing_id() % 4)
    trees = secrets.train(all_.where("k > 0").drop("k"), words_)
    test = all_.where("k = 0").select("label", secrets.features(F.col("candidate"), F.col("left"), F.col("right"), words_).alias("f"))
    right = test.select(((secrets.probability(trees, F.col("f")) >= 0.5).cast("int") == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right >= 0.95


def test_secrets_without_quotes(spark):
    key, word = hashlib.sha1(b"k").hexdigest(), "Tr0ub4dor3xyzQQ1"
    lines = [f"export AWS_SECRET_ACCESS_KEY={key}", f"password={word} omega", f"see https://x.org/a?token={key}&b=1", f"API_KEY_2={key}", f'APP_AUTH_TOKEN_NO_2="{key}"', "passwd=h7Qz9x2K", f"commit={key}", "author: Theodore wrote", "password: required here", "token_type=configuration"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    trees, words_ = secrets.model(df)
    clean = [r.text for r in secrets.redact(df, trees, words_).orderBy("doc_id").collect()]
    assert clean == [x if i > 5 else x.replace(key, "[SECRET]").replace(word, "[SECRET]").replace("h7Qz9x2K", "[SECRET]") for i, x in enumerate(lines)]


def test_forest_on_whole_lines(spark):
    words_ = F.split(F.lit(secrets.WORDS), " ")
    all_ = secrets.labelled_findings(spark, 2600).withColumn("k", F.pmod(F.xxhash64("candidate"), F.lit(4)))
    trees = secrets.train(all_.where("k > 0").drop("k"), words_)
    found = secrets.find(F.concat("left", "candidate", "right"), trees, words_)
    rows = all_.where("k = 0").select("candidate", "label", F.transform(F.filter(found, lambda x: x["p"] >= 0.5), lambda x: x["candidate"]).alias("got")).collect()
    assert sum(r.got == [r.candidate] * r.label for r in rows) >= 0.95 * len(rows)
