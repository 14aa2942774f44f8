import os
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import psutil
from docspark.llm import common, packing


def test_stages_keep_columns_and_effects(spark, tmp_path):
    text = "some plain words that make a fairly long and unremarkable document about {} number {}"
    rows = [(i, text.format("things" * (i % 3 + 1), " ".join(str(i * k) for k in range(1, 12))), "en", f"s{i % 2}", 0, "extra") for i in range(30)]
    rows += [(100, rows[3][1], "en", "s0", 0, "extra"), (101, None, "en", None, None, None), (102, "", "en", "s1", 0, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            assert docs.count() == before.count()
        if name == "near_duplicates":
            assert {100} == {r[0] for r in before.select("doc_id").subtract(docs.select("doc_id")).collect()}
    assert docs.count() > 0


def test_near_duplicates_are_told_by_row_not_by_id(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(5, text(0)), (None, text(0) + " tail"), (None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(0)), (9, text(5)), (3, text(5)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    want = [(5, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (3, text(5)), (None, None), (None, "")]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


_GROWN = """
import psutil
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline

spark = SparkSession.builder.master("local-cluster[1,2,1400]").config("spark.executor.memory", "1100m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{tmp}/shared").getOrCreate()

def executor():
    return max(p.memory_info().rss for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()))

spark.range(6_000_000).groupBy((F.col("id") % 1_000_000).alias("k")).agg(F.collect_list(F.md5(F.col("id").cast("string"))).alias("x")).where("size(x) > 100").count()
docs = spark.createDataFrame([(1, "some words", "s")], "doc_id long, text string, source string")
before = executor()
corpus_pipeline.pack_sequences(spark, docs, "")
print("MEMORY", before, executor())
"""


def test_a_stage_begins_with_small_executors(tmp_path):
    root = str(Path(corpus_pipeline.__file__).parent)
    (tmp_path / "grown.py").write_text(_GROWN.format(tmp=tmp_path))
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable}
    said = subprocess.run([sys.executable, "grown.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    before, after = map(int, said.stdout.split("MEMORY")[1].split())
    assert after < 0.7 * before


def test_cleaning_gives_back_what_the_driver_has_freed_beside_its_heap(spark, monkeypatch):
    jvm, size = spark._jvm, 64_000
    memory, system = jvm.org.apache.spark.unsafe.Platform, psutil.Process(jvm.java.lang.ProcessHandle.current().pid())
    blocks = [memory.allocateMemory(size) for _ in range(2_500)]
    for b in blocks[1:]:
        memory.copyMemory(None, blocks[0], None, b, size)
    held = blocks[::500] + blocks[-1:]  # the C library gives back what is free at the end by itself
    for b in set(blocks) - set(held):
        memory.freeMemory(b)
    for _ in range(2):
        jvm.System.gc()
    monkeypatch.setattr(common, "_TRIM", "noSuchOperation")
    common.clean(spark)
    before = system.memory_info().rss
    monkeypatch.undo()
    common.clean(spark)
    after = system.memory_info().rss
    for b in held:
        memory.freeMemory(b)
    assert before - after > 100e6


def test_packing_tokenizes_the_copies_of_a_mix_once(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"

    def counted():
        from docspark.llm.tokens import encoder

        encode = encoder()

        def one(text):
            with open(calls, "a") as f:
                f.write("x")
            return encode(text)

        return one

    rows = [(i // 2, f"document number {i // 2} " * (i // 2 + 1), "s") for i in range(40)] + [(20, None, "s"), (21, "", "s"), (0, "document number 0 ", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    want = packing.pack(docs).collect()
    monkeypatch.setattr(packing, "encoder", counted)
    got = packing.pack(docs).collect()
    assert sorted(got) == sorted(want)
    assert sum(r.length for r in got if r.doc_id == 7) == 2 * next(r.doc_tokens for r in got if r.doc_id == 7)
    assert len(calls.read_text()) == 22
