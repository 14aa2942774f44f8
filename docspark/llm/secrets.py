"""Secret scans: pattern candidates, false positives removed by a random forest, all in the JVM.

Candidates are long runs of key characters with a digit, shorter ones or ones without a digit after a
secret word and a sign, signed tokens with their dots, and blocks of private keys. The forest looks at a candidate's length,
its character transitions, how much of it dictionary words cover, whether it is part of a path, and
the words beside it. It is trained by Spark's own learner on a bounded table of labelled findings and
then written out as SQL expressions, so scanning is one pass of expressions inside each row: no
shuffle, no join, no Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

_KEY = r"A-Za-z0-9+/_\-"
LEFT, RIGHT = 60, 20
#: A word is in the dictionary if it makes up this share of the corpus, so at most 2,000 can be.
WORD_SHARE = 0.0005
#: The dictionary's part that no corpus need have.
WORDS = "user name file path test data list item view page node type base code main util model index image table event class string object number server client config service controller handler manager factory version release update module package example sample placeholder changeme your here insert"
_SECRET = r"(?i)token|secret|passw|passphrase|pwd|api.?key|access.?key|private|credential|bearer|auth(?!ors?(?![a-z]))"
_PUBLIC = r"(?i)sha|commit|md5|hash|checksum|digest|uuid|guid|revision|\brev\b|version|etag|isbn|phone|card|account|order|invoice|build|\bid\b|trace|session.?id|color|image"
#: What may stand between a name and its value.
_SIGN = r"[\"']?\s{0,2}(?:=>|:=|[=:])\s{0,2}[\"']?"
_NAMED = rf"(?<=[=:>]\s{{0,2}}[\"']?)(?<=(?i:{_SECRET[4:]})[A-Za-z0-9_\-]{{0,16}}{_SIGN})|(?<=(?i:bearer)\s{{1,2}})"
#: A private key with its first line, and a signed token: three parts with dots between.
_BLOCK = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+"
_DOTTED = r"eyJ[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]{4,}+){1,2}+"
#: A long run of key characters with a digit, or any run of eight after a secret word and a sign; '=' only ends one, as padding.
CANDIDATE = rf"(?<![{_KEY}])(?:{_BLOCK}|{_DOTTED}|(?=[A-Za-z+/_\-]*[0-9])[{_KEY}]{{16,}}+|(?=[{_KEY}]{{8}})(?:{_NAMED})[{_KEY}]{{8,}}+)(?:={{1,2}}(?![{_KEY}=]))?"
FEATURES = ["length", "transitions", "digits", "upper", "hexadecimal", "distinct", "covered", "path", "secret_word", "public_word", "assigned", "quoted"]
TREES, DEPTH, SEED = 15, 6, 7
#: The largest number of labelled findings to train on.
MAX_TRAIN = 20_000
LIMIT = 0.5
MARK = "[SECRET]"


def _share(n: Column, c: Column) -> Column:
    return n / F.greatest(F.length(c), F.lit(1))


def _without(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def features(c: Column, left: Column, right: Column, words: Column) -> Column:
    """A struct of numbers about candidate ``c`` between its neighbours."""
    low = F.lower(c)
    held = F.aggregate(F.filter(words, lambda w: F.contains(low, w)), F.lit(0), lambda a, w: a + F.length(w))
    values = {
        "length": F.length(c),
        "transitions": _share(F.regexp_count(c, F.lit(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]")), c),
        "digits": _share(_without(c, "[0-9]"), c),
        "upper": _share(_without(c, "[A-Z]"), c),
        "hexadecimal": c.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "distinct": _share(F.size(F.array_distinct(F.split(c, ""))), c),
        "covered": F.least(F.lit(1.0), _share(held, c)),
        "path": _share(_without(c, "/"), c) * 4 + F.when(left.rlike(r"(?i)(://|[/\\.]|www)\S*$") | right.rlike(r"^[.\\/]\w"), 1.0).otherwise(0.0),
        "secret_word": left.rlike(rf"({_SECRET})[^\n]{{0,24}}$"),
        "public_word": left.rlike(rf"({_PUBLIC})[^\n]{{0,24}}$"),
        "assigned": left.rlike(r"(=|:|=>)\s*[\"']?$"),
        "quoted": left.rlike("[\"']$") & right.rlike("^[\"']"),
    }
    return F.struct(*[values[k].cast("double").alias(k) for k in FEATURES])


def labelled_findings(spark: SparkSession, n: int = 6_000) -> DataFrame:
    """Made-up labelled findings (left, candidate, right, label): real keys beside words that give them
    away, and hashes, identifiers, paths, numbers, long words and placeholders. Deterministic."""

    def draw(salt: int, k: int | Column) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("int")

    def pick(salt: int, *options: str) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), draw(salt, len(options)) + 1)

    def hexes(salt: int, k: int) -> Column:
        return F.substring(F.sha2(F.concat_ws("-", "id", F.lit(salt)), 256), 1, k)

    def base(salt: int, k: int) -> Column:
        return F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws("-", "id", F.lit(salt)), 512))), "[+/=]", "7"), 1, k)

    def word(salt: int) -> Column:
        return pick(salt, *WORDS.split(), "th", "ing", "er", "tion", "re", "ou", "ent", "and", "ha", "en")

    key = pick(1, "token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "API_KEY", "private_key", "credential", "passwd")
    sign = pick(2, ' = "', '="', ": ", "=", ": '", " = ", '": "')
    close = F.when(sign.contains('"'), '"').when(sign.contains("'"), "'").otherwise(pick(3, "\n", " ", ";", ""))
    real = F.element_at(
        F.array(hexes(4, 40), hexes(4, 32), hexes(4, 64), F.concat(F.lit("AKIA"), F.upper(base(5, 16))), F.concat(F.lit("ghp_"), base(6, 36)), F.concat(F.lit("sk_live_"), base(7, 24)), base(8, 40), base(8, 24), F.concat(F.lit("xoxb-"), F.pmod(F.abs(F.xxhash64("id")), F.lit(10**12)).cast("string"), F.lit("-"), base(9, 24))),
        draw(10, 9) + 1,
    )
    uuid = F.concat_ws("-", hexes(11, 8), hexes(12, 4), hexes(13, 4), hexes(14, 4), hexes(15, 12))
    digits = F.substring(F.concat(F.abs(F.xxhash64("id", F.lit(16))).cast("string"), F.abs(F.xxhash64("id", F.lit(17))).cast("string")), 1, 16 + draw(18, 6))
    name = F.concat(word(19), F.initcap(word(20)), F.initcap(word(21)), F.initcap(word(22)), F.initcap(word(23)), draw(24, 100).cast("string"))
    path = F.concat(word(25), F.lit("/"), word(26), F.lit("/"), word(27), F.lit("_"), word(28), draw(29, 1000).cast("string"))
    label_word = pick(30, "commit ", "sha256: ", "md5 = ", "checksum: ", "revision ", "uuid: ", "build ", "etag: \"", "trace id ", "hash=", "digest ", "")
    dummy = F.concat(pick(31, "YOUR_API_KEY_HERE_", "xxxxxxxxxxxxxxxxxxxx", "CHANGEME_PLACEHOLDER_", "insert-your-token-here-", "00000000000000000000", "example_sample_token_"), draw(32, 10).cast("string"))
    lengthy = [w for w in WORDS.split() if len(w) > 3]
    made = F.concat(*[pick(i, "the", "mon", "ter", "lin", "son", "ra", "re", "den", "chi", "val", "ous", "ble", "do", "qui") for i in (64, 65, 66, 67)])
    plain = F.when(draw(62, 2) == 0, F.concat(pick(59, *lengthy), pick(60, "", "_", "-"), pick(61, *lengthy))).when(draw(63, 2) == 0, F.initcap(made)).otherwise(made)
    kinds = [  # left, candidate, right, label
        (F.concat(key, sign), real, close, 1),
        (F.concat(word(33), F.lit(" "), key, sign), real, F.concat(close, F.lit(" "), word(34)), 1),
        (F.concat(word(35), F.lit(" Authorization: Bearer ")), real, F.lit("\n"), 1),
        (F.concat(word(36), F.lit(" "), label_word), hexes(37, 40), pick(38, "\n", " ", "\"", ","), 0),
        (F.concat(word(39), F.lit(" "), label_word), hexes(40, 32), pick(41, "\n", " ", ","), 0),
        (F.concat(word(42), F.lit(" "), pick(43, "id: ", "uuid=", "", "request ", "for ")), uuid, pick(44, "\n", " ", "."), 0),
        (F.concat(word(45), F.lit(" "), pick(46, "", "card ", "phone: ", "account ", "order ", "+")), digits, pick(47, " ", ".", "\n"), 0),
        (F.concat(word(48), F.lit(" "), pick(49, "", "class ", "call ", "import ")), name, pick(50, " ", "(", ".", ";"), 0),
        (pick(51, "https://www.", "/usr/", "see ", "./", "C:\\", "http://x."), path, pick(52, ".html", ".py", " ", "/"), 0),
        (F.concat(key, sign), dummy, close, 0),
        (F.concat(key, sign), F.substring(base(52, 15), F.lit(1), 8 + draw(53, 8)), close, 1),
        (F.concat(key, sign), F.concat(F.translate(F.initcap(F.concat(word(54), word(55))), "oaei", "0431"), F.lpad(draw(56, 10_000).cast("string"), 4, "0"), pick(57, "x", "Qz", "xyzQQ1")), close, 1),
        (F.concat(pick(58, "token", "password", "secret", "credentials", "auth", "private"), sign), plain, close, 0),
    ]
    issued = F.element_at(F.array(F.concat(F.lit("AKIA"), F.upper(base(68, 16))), F.concat(F.lit("ghp_"), base(69, 36)), F.concat(F.lit("sk_live_"), base(70, 24)), F.concat(F.lit("xoxb-"), base(71, 24))), draw(72, 4) + 1)
    signed = F.concat(F.lit("eyJ"), base(73, 33), F.lit(".eyJ"), base(74, 60), F.lit("."), base(75, 43))
    block = F.concat(F.lit("-----BEGIN "), pick(76, "", "RSA ", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----\n"), base(77, 64), F.lit("\n"), base(78, 64), F.lit("\n"), base(79, 30), F.lit("==\n"))
    host = F.concat(F.upper(pick(80, *lengthy)), F.lit("_"), F.upper(pick(81, *lengthy)), F.lit("_"), F.upper(pick(82, *lengthy)), draw(83, 100).cast("string"))
    kinds += [  # keys that tell themselves by their beginning, with nothing beside them
        (F.concat(word(84), F.lit(" ")), issued, F.concat(F.lit(" "), word(85)), 1),
        (F.concat(word(86), F.lit(" ")), signed, F.concat(F.lit(" "), word(87)), 1),
        (F.concat(word(88), F.lit("\n")), block, F.lit("-----END PRIVATE"), 1),
        (F.concat(word(89), F.lit(" ")), host, F.concat(F.lit(" "), word(90)), 0),
    ]
    which = F.pmod(F.col("id"), F.lit(len(kinds)))

    def column(i: int) -> Column:
        return reduce(lambda c, k: c.when(which == k, kinds[k][i] if i < 3 else F.lit(kinds[k][i])), range(1, len(kinds)), F.when(which == 0, kinds[0][i] if i < 3 else F.lit(kinds[0][i])))

    return spark.range(n).select(column(0).alias("left"), column(1).alias("candidate"), column(2).alias("right"), column(3).alias("label"))


def train(findings: DataFrame, words: Column, most: int = MAX_TRAIN) -> list[str]:
    """A forest as its trees' descriptions. Findings with nulls are left out; one class alone is an error of the learner's input
    and gives no trees (every candidate then has probability 0)."""
    rows = findings.dropna(subset=["left", "candidate", "right", "label"]).orderBy(F.xxhash64("candidate", "left"), "candidate", "left").limit(most)
    flat = rows.select(features(F.col("candidate"), F.col("left"), F.col("right"), words).alias("f"), F.col("label").cast("double").alias("label")).select("f.*", "label").repartition(1).cache()
    try:
        if flat.select("label").distinct().count() < 2:
            return []
        data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(flat)
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=3).fit(data)
        return [_tree(t._java_obj.rootNode()) for t in forest.trees]
    finally:
        flat.unpersist()


def _tree(node) -> str:
    """An SQL expression over struct ``f`` for a node of a trained tree."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return repr(float(stats[1] / max(sum(stats), 1e-9))) + "D"
    split = node.split()
    return f"CASE WHEN {FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}D THEN {_tree(node.leftChild())} ELSE {_tree(node.rightChild())} END"


_SPLIT = re.compile(r"CASE WHEN (\w+) <= (\S+)D THEN ")


def probability(trees: list[str], f: Column) -> Column:
    """The mean of the trees over the fields of struct ``f``."""

    def read(s: str, at: int) -> tuple[Column, int]:
        if m := _SPLIT.match(s, at):
            left, at = read(s, m.end())
            right, at = read(s, at + len(" ELSE "))
            return F.when(f[m[1]] <= float(m[2]), left).otherwise(right), at + len(" END")
        end = s.index("D", at)
        return F.lit(float(s[at:end])), end + 1

    if not trees:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, [read(t, 0)[0] for t in trees]) / len(trees)


def dictionary(docs: DataFrame, text: str = "text") -> Column:
    """Common words of four letters or more over all documents, with the fixed ones, as an array literal."""
    words = docs.select(F.explode(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), " ")).alias("w")).where(F.length("w") > 0)
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    lengthy = counts.where(F.length("w") >= 4)
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # Words are about six characters with their space; the share bounds what is collected here.
    common = [r.w for r in lengthy.where(F.col("n") >= max(3.0, WORD_SHARE * total / 6)).select("w").collect()]
    return F.split(F.lit(" ".join(sorted({*common, *(w for w in WORDS.split() if len(w) >= 4)}))), " ")


def find(text: Column, trees: list[str], words: Column) -> Column:
    """array<struct<candidate, p>> of a text, in order; null for a null text, empty where nothing matches."""

    def each(pieces: Column, cands: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            piece = F.get(pieces, i)
            # A name with a digit may be a candidate too: it stays beside the value that a sign gives it.
            named = F.when(F.length(piece) <= 8, F.concat(F.get(cands, i - 1), piece))
            before = F.substring(F.when(named.rlike(rf"^[{_KEY}]+{_SIGN}$"), named).otherwise(piece), -LEFT, LEFT)
            after = F.substring(F.get(pieces, i + 1), 1, RIGHT)
            return F.struct(c.alias("candidate"), let(features(c, before, after, words), lambda f: probability(trees, f)).alias("p"))

        return F.transform(cands, one)

    found = let(F.split(text, CANDIDATE, -1), lambda p: let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda c: each(p, c)))
    return F.when(text.rlike(CANDIDATE), found).when(text.isNotNull(), F.array().cast("array<struct<candidate:string,p:double>>"))


def scan(docs: DataFrame, trees: list[str], words: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate: doc_id, ordinal (its place among its text's candidates), candidate, p.

    Null and empty texts have none; repeated rows are scanned each; an empty table gives an empty
    result; other columns are not read.
    """
    found = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(CANDIDATE)).select("doc_id", find(F.col("text"), trees, words).alias("f"))
    return found.select("doc_id", F.posexplode("f").alias("ordinal", "x")).select("doc_id", "ordinal", "x.candidate", "x.p")


def redact(docs: DataFrame, trees: list[str], words: Column, *, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MARK``; all rows and columns stay, n_chars follows."""
    t = F.col(text)
    found = find(t, trees, words)

    def joined(f: Column) -> Column:
        def put(pieces: Column) -> Column:
            return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.when(F.get(f, i)["p"] >= limit, F.lit(MARK)).otherwise(F.get(f, i)["candidate"]), F.lit("")))), "")

        return F.when(F.exists(f, lambda x: x["p"] >= limit), let(F.split(t, CANDIDATE, -1), put)).otherwise(t)

    out = docs.withColumn(text, F.when(t.rlike(CANDIDATE), let(found, joined)).otherwise(t))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def model(docs: DataFrame) -> tuple[list[str], Column]:
    words = dictionary(docs)
    return train(labelled_findings(docs.sparkSession), words), words


def op1(docs: DataFrame) -> DataFrame:
    trees, words = model(docs)
    out = scan(docs, trees, words)
    return out.select("doc_id", "ordinal", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("p", 6).alias("p"), (F.col("p") >= LIMIT).alias("is_secret"))
