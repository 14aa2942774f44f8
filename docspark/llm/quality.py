"""Quality rules by distribution divergence, in DataFrame functions throughout.

A document's histogram of character classes and its histogram of its language's common words are
held against the same histograms over all documents of that language, by Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1). Short documents are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, keep, let

#: A word is common if it makes up this share of its language's words, so at most 250 can be.
COMMON_SHARE = 0.004
#: Documents with fewer words, and languages with fewer, are not judged by divergence.
MIN_WORDS, MIN_LANGUAGE_WORDS = 80, 5_000
#: Largest distances that pass.
CLASS_LIMIT, WORD_LIMIT = 0.28, 0.36
#: References of so many languages at most are broadcast (about 10 kB each); more are joined by shuffle.
MAX_BROADCAST = 400

_CLASSES = (r"\p{Lu}", r"[0-9]", r"[.,;:!?'\"()\-]")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(h: Column) -> Column:
        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda q, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - q, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        def sorted_(mask: Column) -> Column:
            # A place takes the low bits of its hash, so whole numbers are sorted, not pairs; equal neighbours are told by whole hashes.
            places = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))
            return let(F.sort_array(places), lambda s: let(positions(s, mask), spread))

        def positions(s: Column, mask: Column) -> Column:
            def at(e: Column) -> Column:
                return e.bitwiseAND(mask).cast("int")

            def flag(e: Column, j: Column) -> Column:
                def same(other: Column) -> Column:
                    return F.coalesce(F.get(h, at(other)) == F.get(h, at(e)), F.lit(False))

                return F.when(same(F.get(s, j + 1)) | F.when(j > 0, same(F.get(s, j - 1))).otherwise(F.lit(False)), at(e))

            return F.sort_array(F.filter(F.transform(s, flag), lambda v: v.isNotNull()))

        bits = F.length(F.bin(F.size(h).cast("long")))
        return let(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, sorted_)

    def hashed(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(h, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), F.lit(0)).otherwise(covered(a)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(hashed(words))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays of counts, each with a positive sum)."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def inner(sp: Column, sq: Column) -> Column:
        parts = F.zip_with(p, q, lambda a, b: term(a / sp, (a / sp + b / sq) / 2) / 2 + term(b / sq, (a / sp + b / sq) / 2) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), total(parts)))

    return F.when((total(p) > 0) & (total(q) > 0), let(total(p), lambda sp: let(total(q), lambda sq: inner(sp, sq))))


def _word_distance(hits: Column, n: Column, ref: Column, total: Column) -> Column:
    """Jensen-Shannon distance of a text's common words and all others (``n`` words in all) to its language's.

    A common word that the text lacks adds half of its share in the language, so only those it holds are visited.
    """

    def sums(a: Column, x: Column) -> Column:
        q = F.coalesce(F.element_at(ref, x["word"]), F.lit(0)).cast("double")
        p = x["n"] / n
        both = _half(p, q / total) + _half(q / total, p)
        return F.struct((a["js"] + both).alias("js"), (a["p"] + x["n"]).alias("p"), (a["q"] + q).alias("q"))

    def whole(a: Column) -> Column:
        known = F.aggregate(F.map_values(ref), F.lit(0.0), lambda x, y: x + y)
        p, q = F.greatest(F.lit(0.0), n - a["p"]), F.greatest(F.lit(0.0), total - known)
        # The rest's sums follow from what the common words leave, so both histograms sum to 1 but for words counted two ways.
        sp, sq = F.greatest(n.cast("double"), a["p"]), F.greatest(total.cast("double"), known)
        rest = _half(p / sp, q / sq) + _half(q / sq, p / sp) + (known - a["q"]) / sq / 2
        return F.sqrt(F.greatest(F.lit(0.0), a["js"] + rest))

    zero = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    return F.when((n > 0) & (total > 0), let(F.aggregate(hits, zero, sums), whole))


def _half(p: Column, q: Column) -> Column:
    """One side's part of the divergence, in bits: p / 2 log2(p / m) with m midway between p and q."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q)) / 2).otherwise(F.lit(0.0))


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row: doc_id, lang, the base measures, and the distances ``class_distance`` and
    ``word_distance`` (null where the document or its language is too short to judge).

    Null and empty texts have no words. A null language is a language of its own. Repeated rows are
    measured alike; an empty table gives an empty result; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), body.alias("text"))
    letters = r"[^\p{L}]+"
    counts = keep(
        rows.select("lang", F.explode(F.split(F.regexp_replace(F.lower("text"), letters, " "), " ")).alias("word")).where("word != ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = keep(counts.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= MIN_LANGUAGE_WORDS))
    few = totals.count() <= MAX_BROADCAST
    near = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    # No word below this count can be common, so the vocabulary's long tail is not joined.
    often = counts.where(F.col("n") >= COMMON_SHARE * MIN_LANGUAGE_WORDS)
    common = often.join(near(totals), "lang").where(F.col("n") >= COMMON_SHARE * F.col("total")).groupBy("lang", "total").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("c"))
    common = keep(common.select("lang", F.col("total").alias("lang_words"), F.map_keys("c").alias("words"), F.col("c").alias("word_ref")))

    n_chars = F.length("text")
    word_chars = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    cls = [F.regexp_count("text", F.lit(c)) for c in _CLASSES]
    tokens = F.split(F.regexp_replace(F.lower("text"), letters, " "), " ")

    def hits(t: Column) -> Column:
        """The common words that a text holds, found by hash, and how often it does."""
        return F.transform(F.array_intersect("words", t), lambda w: F.struct(w.alias("word"), (F.size(t) - F.size(F.array_remove(t, w))).cast("double").alias("n")))

    wide = rows.join(near(common), "lang", "left").select(
        "doc_id",
        "lang",
        "lang_words",
        "word_ref",
        n_chars.alias("n_chars"),
        word_chars.cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        let(
            F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")),
        ).alias("w"),
        F.array(*cls).alias("cls"),
        F.when(F.col("words").isNotNull(), let(tokens, hits)).alias("hits"),
    )
    # Symbols, white space and all else (mostly lower-case letters) complete the classes.
    known = F.aggregate("cls", F.lit(0), lambda a, b: a + b) + F.col("n_symbols") + (F.col("n_chars") - F.col("word_chars"))
    full = F.transform(F.concat(F.col("cls").cast("array<long>"), F.array(F.col("n_symbols"), F.col("n_chars") - F.col("word_chars"), F.col("n_chars") - known)), lambda v: v.cast("double"))
    judged = (F.col("n_words") >= MIN_WORDS) & F.col("lang_words").isNotNull()
    words = _word_distance(F.col("hits"), F.col("n_words"), F.col("word_ref"), F.col("lang_words"))
    got = keep(
        wide.select("*", F.col("w.n").alias("n_words"), F.col("w.r").alias("n_repeat_words")).select(
            "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", judged.alias("judged"), full.alias("classes"), F.when(judged, words).alias("word_distance")
        )
    )
    # The class reference of a language: the sum over its documents, six numbers a language.
    n = len(_CLASSES) + 3
    ref = got.groupBy("lang").agg(F.array(*[F.sum(F.col("classes")[i]) for i in range(n)]).alias("class_ref"))
    return (
        got.join(near(ref), "lang", "left")
        .withColumn("class_distance", F.when(F.col("judged"), _distance(F.col("classes"), F.col("class_ref"))))
        .select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance")
    )


def op5(docs: DataFrame) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= CLASS_LIMIT) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT)
    m = measure(docs).withColumn("base_failed", base)
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
