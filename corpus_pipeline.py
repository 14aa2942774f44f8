"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables; columns
beyond those of documents go through all stages but the last. What a stage does with them is said below.
Each stage begins with heaps that have given back what the stage before has left free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import jaccard_join, mixing, packing, secrets, toxicity
from docspark.llm.common import keep, made, read_table, relieve, sweep

#: So many removed rows at most are broadcast (64 MB).
MOST_BROADCAST = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels, does not call toxic.

    Null and empty texts, which get the models' biases, are judged like others; repeated rows are judged
    alike; without labels all rows stay.
    """
    relieve(spark)
    chain = toxicity.train(docs, read_table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    scored = toxicity.score(docs, chain, prefix="__p_")
    return scored.where(F.col("__p_toxic") < toxicity.LIMIT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at 0.8 over five words: that with the smallest id, a null id last. Ids may be null or shared; rows without words stay."""
    relieve(spark)
    rows = keep(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = keep(jaccard_join.near_duplicates(rows, size=5, percent=80, key="__row")).select(F.col("doc_id").alias("__row"), "component_id")
    relieve(spark)
    several = found.where("__row <> component_id").select("component_id").distinct()
    ids = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", F.xxhash64("text").alias("h"), "__row").alias("id"))
    members = keep(found.join(several, "component_id", "left_semi").join(ids, "__row"))
    first = members.groupBy("component_id").agg(F.min("id").alias("first"))
    gone = members.join(first, "component_id").where("__row <> first.__row").select("__row")
    gone = keep(gone)
    few = gone.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(gone) if few else gone, "__row", "left_anti").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the forest holds for secrets replaced; null texts stay null, n_chars follows the text."""
    relieve(spark)
    trees, words = secrets.model(docs)
    return secrets.redact(docs, trees, words)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice. A null source is a source; rows without words are not taken."""
    relieve(spark)
    return mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a training sequence. A null text is one token, the end of its document.

    The target mixture is that which the stage before has made, so sources keep their shares in every window.
    """
    relieve(spark)
    return packing.with_crc(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages train models and hash texts; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = made()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs)
            sweep(spark, before, but=1)  # what the stage has read and made is in its result
    return docs
