import threading
from datetime import datetime, timezone

import pytest

from docspark import BigInt, Engine, QueryBuilder, Signal, inspect_storage, restore_backup, verify_backup
from docspark.errors import AmbiguousField, Closed, DocsparkError, IntegrityError, InvalidDocument, InvalidOption, ReadOnly, SyntaxProblem, TimedOut, UnknownFunction, UnsupportedSyntax

WHEN = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


@pytest.fixture
def engine(spark):
    with Engine(spark) as e:
        yield e


def people(e):
    e.execute("INSERT INTO people", [
        {"name": "Ann", "age": 30, "role": "dev", "score": 9, "nickname": None},
        {"name": "Bob", "age": 25, "role": "ops", "score": 7},
        {"name": "Cid", "age": 41, "role": "dev", "score": 8, "nickname": "C"},
        {"name": "Dee", "age": None, "role": "qa", "score": 9.5},
    ])


def names(rows):
    return [r["name"] for r in rows]


def test_round_trip_of_every_type(engine):
    doc = {"n": None, "t": True, "f": False, "i": 3, "d": 2.5, "b": BigInt(10**30), "at": WHEN, "bytes": b"\0\1", "long": "x" * 440, "list": [1, "a", None, BigInt(7), WHEN, {"$date": 1}], "o": {"label": "l", "none": None}}
    assert engine.execute("INSERT INTO typed", doc) == 1
    assert engine.execute("FIND typed") == [doc]
    assert engine.execute("SELECT t, f, b, at FROM typed") == [{"object_id": 1, "t": 1, "f": 0, "b": str(10**30), "at": 1714564800000}]


@pytest.mark.parametrize("bad", [{"a.b": 1}, {"__proto__": 1}, {"a": float("nan")}, {"a": object()}, {"a\0": 1}])
def test_invalid_documents_change_nothing(engine, bad):
    with pytest.raises(InvalidDocument):
        engine.execute("INSERT INTO c", [{"ok": 1}, bad])
    assert engine.execute("FIND c") == []


def test_circular_and_deep(engine):
    a = {}
    a["a"] = a
    with pytest.raises(InvalidDocument):
        engine.execute("INSERT INTO c", a)


@pytest.mark.parametrize(
    ("where", "found"),
    [
        ("age > 26", ["Ann", "Cid"]),
        ("age BETWEEN 25 AND 30", ["Ann", "Bob"]),
        ("name LIKE 'a%' OR name GLOB 'B*'", ["Ann", "Bob"]),
        ("role IN ('dev', 'qa') AND NOT score = 8", ["Ann", "Dee"]),
        ("age IS NULL", ["Dee"]),
        ("nickname IS NOT NULL", ["Cid"]),
        ("NOT (age > 26 OR nowhere = 1)", []),
        ("role = 1 OR age = '30'", []),
        ("name < 'C' AND age < 'z'", ["Ann", "Bob"]),
        ("role NOT LIKE 'd%' AND role <> 'qa'", ["Bob"]),
    ],
)
def test_filters(engine, where, found):
    people(engine)
    assert names(engine.execute(f"SELECT name FROM people WHERE {where} ORDER BY name")) == found


def test_grouping(engine):
    people(engine)
    rows = engine.execute("SELECT role, COUNT(*) AS n, AVG(age) AS a FROM people GROUP BY role HAVING n >= 1 ORDER BY n DESC, role")
    assert rows == [{"role": "dev", "n": 2, "a": 35.5}, {"role": "ops", "n": 1, "a": 25.0}, {"role": "qa", "n": 1, "a": None}]
    assert engine.execute("SELECT name, MAX(score) AS m FROM people") == [{"name": "Dee", "m": 9.5}]
    assert engine.execute("SELECT TOTAL(age) AS t, SUM(age) AS s, GROUP_CONCAT(role) AS g FROM people WHERE age > 100") == [{"t": 0.0, "s": None, "g": None}]
    with pytest.raises(SyntaxProblem):
        engine.execute("SELECT SUM(COUNT(*)) AS x FROM people")


def test_parameters(engine):
    people(engine)
    assert names(engine.execute("SELECT name FROM people WHERE role = ? AND score > ?", ["dev", 8])) == ["Ann"]
    assert names(engine.execute("SELECT name FROM people WHERE role = $r", {"r": "x", "$r": "qa"})) == ["Dee"]
    assert names(engine.execute("SELECT name FROM people WHERE age = ?", 25)) == ["Bob"]
    assert names(engine.execute("SELECT name FROM people ORDER BY name LIMIT ? OFFSET ?", [2, 1])) == ["Bob", "Cid"]
    for bad in ([], {"x": 1}, None):
        with pytest.raises(InvalidOption):
            engine.execute("SELECT name FROM people WHERE role = ?", bad)


def test_names_and_wildcards(engine):
    engine.execute("INSERT INTO w", {"title": "T", "home": {"city": "H", "code": 1}, "work": {"city": "W", "code": 2}, "only": {"deep": {"leaf": 5}}})
    one = lambda s: engine.execute(s)[0]
    assert one("SELECT leaf FROM w") == {"object_id": 1, "leaf": 5}
    assert one("SELECT city FROM w") == {"object_id": 1, "home.city": "H", "work.city": "W"}
    assert one("SELECT home.city FROM w x WHERE x.title = 'T'") == {"object_id": 1, "home.city": "H"}
    assert one("SELECT ? FROM w") == {"object_id": 1, "title": "T", "home": 2, "work": 2, "only": 1}
    assert one("SELECT only.* FROM w") == {"object_id": 1, "deep": 1, "leaf": 5}
    assert one("SELECT home FROM w") == {"object_id": 1, "home": {"city": "H", "code": 1}}
    assert engine.execute("SELECT title FROM w WHERE city = 'W'") and not engine.execute("SELECT title FROM w WHERE city <> 'W'")
    for bad, error in (("SELECT UPPER(city) AS c FROM w", AmbiguousField), ("SELECT city AS c FROM w", SyntaxProblem), ("SELECT title AS a, only AS A FROM w", SyntaxProblem), ("SELECT DISTINCT home FROM w", UnsupportedSyntax), ("SELECT DISTINCT * FROM w", UnsupportedSyntax)):
        with pytest.raises(error):
            engine.execute(bad)


def test_quoted_and_reserved_names(engine):
    engine.execute("INSERT INTO order-log", {"first-name": "A", "order": 1, "select": 2, "shipping-address": {"zip-code": "9"}})
    assert engine.execute('SELECT "first-name", "order" AS o, "shipping-address"."zip-code" AS z FROM order-log WHERE "select" = 2') == [{"object_id": 1, "first-name": "A", "o": 1, "z": "9"}]


def test_mixed_types_in_one_path(engine):
    engine.execute("INSERT INTO m", [{"v": x} for x in (True, 1, WHEN, "1", b"x", [1], {"k": 1}, 2.5, None)])
    assert [d["v"] for d in engine.execute("SELECT * FROM m")] == [True, 1, WHEN, "1", b"x", [1], {"k": 1}, 2.5, None]
    assert len(engine.execute("SELECT v FROM m WHERE v = 1")) == 2
    kinds = [r["t"] for r in engine.execute("SELECT typeof(v) AS t FROM m ORDER BY v, object_id")]
    assert kinds[:4] == ["null", "integer", "integer", "real"] and kinds[-1] in ("blob", "text")
    engine.execute("INSERT INTO d", [{"v": x} for x in (True, 1, False, 0)] + [{"v": datetime(1970, 1, 1, 0, 0, 0, 1000, tzinfo=timezone.utc)}])
    assert sorted(r["v"] for r in engine.execute("SELECT DISTINCT v FROM d")) == [0, 1]


def test_arithmetic(engine):
    engine.execute("INSERT INTO a", {"i": 7, "r": 7.5, "s": "5x"})
    assert engine.execute("SELECT i/2 AS a, i/2.0 AS b, r/2 AS c, i%0 AS d, s*2 AS e, -i AS f, i||'!' AS g, i > 3 AS h, 1 + NULL AS n FROM a") == [{"object_id": 1, "a": 3, "b": 3, "c": 3.75, "d": None, "e": 10.0, "f": -7, "g": "7!", "h": 1, "n": None}]
    assert engine.execute("SELECT SUBSTR('hello', 0, 2) AS a, SUBSTR('hello', -3) AS b, SUBSTR('hello', 2, 100) AS c, INSTR('hello', 'l') AS d, ROUND(2.567, 1) AS e, MAX(1, NULL) AS f, CASE WHEN i = 7 THEN 'x' END AS g FROM a") == [{"a": "h", "b": "llo", "c": "ello", "d": 3, "e": 2.6, "f": None, "g": "x"}]
    with pytest.raises(UnknownFunction):
        engine.execute("SELECT nosuch(i) AS x FROM a")


def test_mutations(engine):
    people(engine)
    assert engine.execute("UPDATE people WHERE name = 'Ann'", {"age": 31, "extra": {"a": 1, "b": 2}}) == [{"object_id": 1}]
    engine.execute("UPDATE people WHERE name = 'Ann'", {"extra": {"b": 3}})
    assert engine.execute("SELECT * FROM people WHERE name = 'Ann'") == [{"name": "Ann", "age": 31, "role": "dev", "score": 9, "nickname": None, "extra": {"a": 1, "b": 3}}]
    engine.execute("UPDATE people SET age = score, score = age, up = UPPER(name), big = score > 8 WHERE name = 'Bob'")
    assert engine.execute("SELECT age, score, up, big FROM people WHERE name = 'Bob'") == [{"object_id": 2, "age": 7, "score": 25, "up": "BOB", "big": 0}]
    assert engine.execute("UNSET extra.a, nickname FROM people WHERE name = 'Ann'") == [{"object_id": 1}]
    assert engine.execute("FIND people WHERE name = 'Ann'") == [{"name": "Ann", "age": 31, "role": "dev", "score": 9, "extra": {"b": 3}}]
    assert engine.execute("DELETE FROM people ORDER BY name DESC LIMIT 1") == [{"object_id": 4}]
    assert engine.execute("REPLACE INTO people WHERE name = $name", {"name": "Cid"}) == [{"object_id": 3}]
    assert engine.execute("FIND people WHERE name = 'Cid'") == [{"name": "Cid"}]
    assert engine.execute("UPSERT INTO people WHERE name = $name", {"name": "Eve"}) == [{"object_id": 5, "inserted": True}]
    assert engine.execute("UPSERT INTO people WHERE name = 'Zed'", {"name": "Zed"}, require_match=True) == []
    for bad in ("UPDATE people GROUP BY name", "UPSERT INTO people", "UNSET * FROM people", "WITH x AS (SELECT 1) SELECT 1", "SELECT 1 FROM a UNION SELECT 2 FROM b", "SELECT a FROM b JOIN c ON 1"):
        with pytest.raises(SyntaxProblem):
            engine.execute(bad, {"a": 1})
    with pytest.raises(InvalidDocument):
        engine.execute("UPDATE people WHERE name = 'Ann'", [{"a": 1}])
    with pytest.raises(InvalidOption):
        engine.execute("SELECT name FROM people", require_match=True)
    assert not engine.run("SELECT").ok


def test_scalar_roots_and_empty(engine):
    engine.execute("INSERT INTO s", ["SELECT 1", 5, {"k": 1}])
    assert engine.execute("FIND s") == ["SELECT 1", 5, {"k": 1}]
    assert engine.execute("SELECT a FROM nothing") == []
    assert engine.execute("SELECT COUNT(*) AS n FROM nothing") == [{"n": 0}]


def test_streaming_and_limits(engine, spark):
    engine.execute("INSERT INTO x", [{"v": i} for i in range(125)])
    sizes = [len(b) for b in engine.stream("SELECT v FROM x ORDER BY v", batch_size=17)]
    assert sizes == [17] * 7 + [6]
    s = engine.stream("FIND x", batch_size=19)
    assert len(next(s)) == 19
    s.close()
    with pytest.raises(SyntaxProblem):
        engine.stream("DELETE FROM x")
    with pytest.raises(InvalidOption):
        list(engine.stream("FIND x", batch_size=0))
    stop = Signal()
    stop.abort()
    with pytest.raises(DocsparkError):
        engine.execute("FIND x", signal=stop)
    with pytest.raises(TimedOut):
        engine.execute("QUERY ON x SELECT count(*) AS n FROM range(100000000000) a WHERE sqrt(id) > 1", timeout_ms=300)
    assert engine.execute("SELECT COUNT(*) AS n FROM x") == [{"n": 125}]
    rows, more = engine.bounded("SELECT v FROM x", limit=10)
    assert len(rows) == 10 and more


def test_structure(engine):
    engine.execute("INSERT INTO p", [{"name": "a", "contact": {"email": "e", "phone": None}, "mixed": 1}, {"name": "b", "contact": None, "mixed": "x"}, {"name": "c", "mixed": {"k": 1}}])
    s = engine.structure("p")
    kids = {c.path: c for c in s.root.children}
    assert s.documents == 3 and kids["name"].coverage == 1 and not kids["name"].optional
    assert kids["contact"].types == (("object", 1), ("null", 1)) and kids["contact"].optional
    assert dict(kids["mixed"].types) == {"object": 1, "string": 1, "number": 1}
    email = kids["contact"].children[0]
    assert email.coverage == pytest.approx(1 / 3) and email.coverage_within_parent == 1 and not email.optional_within_parent
    assert engine.structure("p", "contact").root.path == "contact"


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    a.execute("INSERT INTO c", {"key": 1, "n": 0})
    work = [threading.Thread(target=e.execute, args=(f"UPDATE c WHERE key = 1", {f"f{i}": i})) for i, e in enumerate((a, b, a, b))]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert a.execute("FIND c") == b.execute("FIND c") == [{"key": 1, "n": 0, "f0": 0, "f1": 1, "f2": 2, "f3": 3}] or set(a.execute("FIND c")[0]) == {"key", "n", "f0", "f1", "f2", "f3"}


def test_storage_backup_and_readonly(spark, tmp_path):
    root = tmp_path / "db"
    with Engine(spark, str(root), durability="strict") as e:
        e.execute("INSERT INTO one", [{"k": i} for i in range(5)])
        e.execute("UPDATE one SET k = k + 1")
        assert e.storage_stats("one")["one"]["reclaimable_bytes"] > 0
        assert e.vacuum("one")["removed"] >= 1
        e.backup(str(tmp_path / "bk"))
        with pytest.raises(InvalidOption):
            e.backup(str(root / "inside"))
    with pytest.raises(Closed):
        e.execute("FIND one")
    assert verify_backup(tmp_path / "bk", spark)["collections"]["one"]["rows"] == 5
    restore_backup(tmp_path / "bk", tmp_path / "again")
    with Engine(spark, str(tmp_path / "again"), mode="readonly") as r:
        assert [d["k"] for d in r.execute("FIND one ORDER BY k")] == [1, 2, 3, 4, 5]
        with pytest.raises(ReadOnly):
            r.execute("DELETE FROM one")
    part = next(p for p in (tmp_path / "bk").rglob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1])
    with pytest.raises(IntegrityError):
        verify_backup(tmp_path / "bk")
    assert inspect_storage(root)["collections"][0]["rows"] == 5


def test_builder_and_register(engine, spark):
    engine.register("nums", spark.range(10).withColumnRenamed("id", "v"), "v")
    text, params = QueryBuilder("nums").select("v").where("v", ">=", 7).order("v", True).limit(2).build()
    assert engine.execute(text, params) == [{"object_id": 9, "v": 9}, {"object_id": 8, "v": 8}]
    with pytest.raises(ReadOnly):
        engine.execute("DELETE FROM nums")
    assert engine.execute("QUERY ON nums SELECT sum(v) AS s FROM nums") == [{"s": 45}]
    plan = engine.query("SELECT v FROM nums WHERE v > 3")._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("mode", ["readwrite", "readonly"])
def test_raw_statements_only_read_collections(spark, tmp_path, mode):
    root, out = tmp_path / "db", tmp_path / "out"
    with Engine(spark, str(root)) as e:
        e.execute("INSERT INTO a", [{"k": i} for i in range(5)])
        e.execute("INSERT INTO b", [{"k": 2, "n": "x"}])
    with Engine(spark, str(root), mode=mode) as e:
        for bad in (
            f"QUERY ON a WITH w AS (SELECT k FROM a) INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT * FROM w",
            f"QUERY ON a SELECT * FROM parquet.`{root}/a`",
            f"QUERY ON a SELECT k FROM a WHERE k IN (SELECT k FROM parquet.`{root}/a`)",
            "QUERY ON a WITH w AS (SELECT 1) SELECT * FROM elsewhere",
            "QUERY ON a EXPLAIN CREATE TABLE t AS SELECT 1",
        ):
            with pytest.raises(DocsparkError):
                e.execute(bad)
        assert not out.exists()
        assert e.execute("QUERY ON a WITH w AS (SELECT k FROM a WHERE k > $low) SELECT w.k, n FROM w JOIN b ON w.k = b.k", {"$low": 1}) == [{"k": 2, "n": "x"}]
        assert e.execute("QUERY ON a SELECT k FROM a WHERE k IN (SELECT k FROM b)") == [{"k": 2}]
        assert "Scan" in str(e.execute("QUERY ON a EXPLAIN SELECT k FROM a"))
        recursive = "QUERY ON a WITH RECURSIVE r(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM r WHERE i < 4) SELECT count(*) AS n FROM r"
        assert e.execute(recursive) == [{"n": 4}]


def test_lost_files_are_errors(spark, tmp_path):
    root = tmp_path / "db"
    with Engine(spark, str(root)) as e:
        e.load("c", spark.range(1000).withColumnRenamed("id", "k").repartition(4), "k")
        assert e.execute("SELECT COUNT(*) AS n FROM c")[0]["n"] == 1000
    next((root / "c").glob("part-*/*.parquet")).unlink()
    with Engine(spark, str(root)) as e, pytest.raises(IntegrityError):
        e.execute("SELECT COUNT(*) AS n FROM c")


def test_readers_outlive_vacuum(spark, tmp_path):
    with Engine(spark, str(tmp_path / "db")) as e:
        e.execute("INSERT INTO c", [{"k": i} for i in range(5)])
        df, rows = e.query("SELECT k FROM c"), e.stream("SELECT k FROM c", batch_size=2)
        first = next(rows)
        e.execute("UPDATE c SET k = k + 10")
        assert e.vacuum("c")["leased"] >= 1
        assert sorted(r.k for r in df.collect()) == [0, 1, 2, 3, 4]
        assert len(first) + sum(map(len, rows)) == 5
        e.lease_s = 0
        assert e.vacuum("c")["leased"] == 0


def test_function_results_have_their_types(spark):
    with Engine(spark) as e:
        e.execute("INSERT INTO f", [{"j": '{"k": 7, "s": "7", "b": true, "n": null, "a": [1, 2], "r": 1.5}', "x": 5.5, "t": "Éaé"}])
        one = lambda expr: e.execute(f"SELECT {expr} AS v FROM f")[0]["v"]
        assert one("JSON_EXTRACT(j, '$.k') = 7") == 1 and one("JSON_EXTRACT(j, '$.k') > 50") == 0 and one("JSON_EXTRACT(j, '$.s') = 7") == 0 and one("JSON_EXTRACT(j, '$.s') = '7'") == 1
        assert one("JSON_EXTRACT(j, '$.b') = 1") == 1 and one("JSON_EXTRACT(j, '$.r') * 2") == 3
        assert one("j -> '$.s'") == '"7"' and one("j ->> '$.s'") == "7"
        assert [one(f"JSON_TYPE(j, '$.{k}')") for k in "ksbnar"] == ["integer", "text", "true", "null", "array", "real"] and one("JSON_TYPE(j)") == "object"
        assert one("FLOOR(x) / 2") == 2.5 and one("CEIL(x) / 4") == 1.5 and one("TRUNC(-5.5)") == -5 and one("FLOOR(7) / 2") == 3
        assert one("UPPER(t)") == "ÉAé" and one("LOWER(t)") == "Éaé"
        assert one("PRINTF('%d|%05.1f|%s|%%', 5.5, x, 3)") == "5|005.5|3|%"


def test_learner_evaluates_by_itself(spark, tmp_path):
    root = tmp_path / "db"
    with Engine(spark, str(root), field_indexes={"mode": "auto", "preset": "aggressive"}) as e:
        e.load("c", spark.range(200).withColumnRenamed("id", "k"), "k")
        for i in range(3):
            e.execute("SELECT k FROM c WHERE k = ?", [i])
        assert e._store("c").read()["learner"]["managed"].keys() == {"k"}


MANY = {
    "DELETE FROM c WHERE k > 99": lambda k: None if k > 99 else (k, 0),
    "UNSET v FROM c WHERE k > 99": lambda k: (k, None if k > 99 else 0),
    "UPDATE c SET k = v, v = k": lambda k: (0, k),
}


@pytest.mark.parametrize("statement", MANY)
def test_the_driver_never_holds_the_ids_of_a_large_mutation(spark, tmp_path, monkeypatch, statement):
    n, at_once = 30_000, []
    kind = type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: at_once.append(len(rows := collect(df))) or rows)
    with Engine(spark, str(tmp_path / "db"), lease_s=0) as e:
        e.load("c", spark.range(1, n + 1).selectExpr("id AS k", "0L AS v"), "k")
        got = e.execute(statement)
        assert max(at_once, default=0) <= 10_000
        expected = [{"object_id": k} for k in range(1, n + 1) if MANY[statement](k) != (k, 0)]
        assert len(got) == len(expected) and got == expected and expected == got and got != expected[1:]
        assert got[0] == expected[0] and got[-1] == expected[-1] and got[5:9:2] == expected[5:9:2] and expected[3] in got
        rows = [tuple(r) for r in e.frame("c").orderBy("object_id").select("k", "v").toLocalIterator()]
        assert rows == [x for k in range(1, n + 1) if (x := MANY[statement](k)) is not None]
        assert e._store("c").read()["rows"] == len(rows)
        e.execute("UPDATE c SET v = 8")  # what a mutation matched stays what it was
        assert got == expected
        assert e.vacuum("c")["leased"] == 0 and e.storage_stats("c")["c"]["reclaimable_bytes"] == 0


def test_a_json_value_is_parsed_once(spark):
    odd = ["7", '"7"', "true", "false", "null", "[1, 2]", '{"a": 1}', "1.5", "1e400", "12345678901234567890123", '"60"', "60", "-3", '""']
    texts = [f'{{"k": {x}}}' for x in odd] + ["{}", "no JSON", None, '{"k": 1, "k": 2}']
    with Engine(spark) as e:
        e.register("j", spark.createDataFrame(list(enumerate(texts)), "i int, j string"), "i")
        at = lambda where: [r["i"] for r in e.execute(f"SELECT i FROM j WHERE {where} ORDER BY i")]
        assert at("JSON_EXTRACT(j, '$.k') > 50") == [1, 5, 6, 8, 9, 10, 11, 13]  # text is above every number
        assert at("JSON_EXTRACT(j, '$.k') <> 7") == [1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13]
        assert at("JSON_EXTRACT(j, '$.k') = '[1,2]'") == [5] and at("JSON_EXTRACT(j, '$.k') + 1 = 8") == [0, 1]
        assert at("JSON_EXTRACT(j, '$.k') = JSON_EXTRACT(j, '$.k')") == list(range(4)) + list(range(5, 14))
        assert [r["t"] for r in e.execute("SELECT JSON_TYPE(j, '$.k') AS t FROM j ORDER BY i")] == ["integer", "text", "true", "false", "null", "array", "object", "real", "real", "real", "text", "integer", "integer", "text", None, None, None, None]
        for what, times in {"i FROM j WHERE JSON_EXTRACT(j, '$.k') > 50 AND JSON_EXTRACT(j, '$.k') <> 69": 2, "JSON_EXTRACT(j, '$.k') * 2 AS d FROM j": 1, "JSON_TYPE(j, '$.k') AS t FROM j": 1}.items():
            plan = e.query(f"SELECT {what}")._jdf.queryExecution().optimizedPlan().toString()
            assert 1 <= plan.count("parseJson") <= times
