import pytest
from pyspark.sql import functions as F

from oppflow.functions import arrays, text
from oppflow.operators import constraints as cs, evidence, feed, records, runs, versions
from oppflow.streaming.versions import follow_changes


def test_actions_of_repeated_observations(spark):
    rows = [("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("k", 4, "a"), ("n", 1, None), ("n", 2, None), ("o", 1, "x")]
    stored = spark.createDataFrame([("k", "a", 4), ("o", "y", 1)], "key string, _fingerprint string, _version int")
    df = spark.createDataFrame(rows, "key string, at int, h string")
    got = {(r.key, r["at"]): (r.action, r.version_no) for r in versions.observed_actions(df, ["key"], [F.col("at")], F.col("h"), stored).collect()}
    assert got == {
        ("k", 1): ("unchanged", 4), ("k", 2): ("unchanged", 4), ("k", 3): ("changed", 5), ("k", 4): ("changed", 6), ("n", 1): ("created", 1), ("n", 2): ("unchanged", 1), ("o", 1): ("changed", 2)
    }


def test_merge(spark):
    old = spark.createDataFrame([("1", "t", "h", "processed"), ("2", "t", "h", "processed"), ("3", "t", "h", "processed")], "key string, title string, hash string, state string")
    new = spark.createDataFrame([("2", None, "h", 1), ("3", None, "h2", 1), ("4", "n", "h", 1), ("4", "m", "g", 2)], "key string, title string, hash string, at int")
    got = {r.key: (r.title, r.hash, r.state, r.action) for r in versions.merge_current(old, new, ["key"], "hash", "at", ["title"], {"state": "pending"}).collect()}
    assert got == {"1": ("t", "h", "processed", "kept"), "2": ("t", "h", "processed", "unchanged"), "3": ("t", "h2", "pending", "changed"), "4": ("m", "g", "pending", "created")}


def test_upsert_update_delete_latest(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "id int, v string")
    assert sorted(map(tuple, versions.upsert(df, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, None)]
    assert sorted(map(tuple, versions.updated(df, new, ["id"]).collect())) == [(1, "a"), (2, "c")]
    assert [r.id for r in versions.without(df, new, ["id"]).collect()] == [1]
    many = spark.createDataFrame([("k", i, i % 7 == 0) for i in range(1, 40)], "k string, n int, ok boolean")
    assert versions.latest(many, ["k"], [F.col("n").desc()], qualifying=F.col("ok")).first().n == 35
    assert versions.latest(many, ["k"], [F.col("n").desc()], among=3, qualifying=F.col("ok")).collect() == []


@pytest.mark.parametrize("current,previous,allowed,bound", [(222, None, False, None), (222, 222, True, 156), (80, 222, False, 156), (140, 200, True, 140), (40, 50, False, 50), (5, 0, False, None)])
def test_closure_guard(spark, current, previous, allowed, bound):
    df = spark.createDataFrame([(current, previous)], "c int, p int")
    a, b = runs.closure_guard(F.col("c"), F.col("p"))
    assert tuple(df.select(a, b).first()) == (allowed, bound)


def test_runs(spark):
    df = spark.createDataFrame([("s", i, "succeeded" if i != 2 else "failed", i * 10, f"e{i}") for i in range(1, 9)], "s string, n int, status string, found int, e string")
    got = runs.with_previous(df, ["s"], [F.col("n")], "found", "previous", F.col("status") == "succeeded").orderBy("n").collect()
    assert [r.previous for r in got] == [None, 10, 10, 30, 40, 50, 60, 70]
    assert runs.first_errors(df, ["s"], "e", ["n"]).first().errors == "e1; e2; e3; e4; e5"
    assert [r.batch_no for r in runs.numbered_batches(df, ["s"], [F.col("n")], 3).orderBy("n").collect()] == [1, 1, 1, 2, 2, 2, 3, 3]
    with pytest.raises(ValueError):
        runs.numbered_batches(df, ["s"], [F.col("n")], 0)


def test_feed(spark, data):
    df = spark.createDataFrame([("1", "50% af", None), ("2", "500 af", "x"), ("3", None, "x")], "id string, title string, province string")
    assert [r.id for r in feed.filtered(df, {"search": " 50% "}).collect()] == ["1", "2"]
    assert [r.id for r in feed.filtered(df, {"search": "50%"}, escape=True).collect()] == ["1"]
    assert [r.id for r in feed.filtered(df, {"province": "x", "search": ""}).orderBy("id").collect()] == ["2", "3"]
    with pytest.raises(ValueError):
        feed.filtered(df, {"nope": "x"})
    with pytest.raises(ValueError):
        feed.page(df, 101)
    parents = spark.createDataFrame([(1,), (2,)], "p int")
    kids = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "q int, n int, v string")
    assert [[tuple(x) for x in r.kids] for r in feed.nested(parents, kids, "p", "q", ["n", "v"], "kids").orderBy("p").collect()] == [[(1, "a"), (2, "b")], []]


def test_plans(spark, data):
    from oppflow.plans import ingestion, listing

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(listing.feed_for_you(spark, data)) or "GlobalLimit" in plan(listing.feed_for_you(spark, data))
    queue = plan(ingestion.extraction_queue(spark, data))
    assert "LeftAnti" in queue and "EqualTo(source_status,active)" in queue
    assert "raw_content" not in plan(ingestion.changed_since_stored(spark, data))


def test_constraints(spark):
    df = spark.createDataFrame([(1, 5, 3, " "), (2, None, 3, "a"), (3, 1, 3, None)], "id int, low int, high int, t string")
    got = cs.checked(df, {"range": cs.not_below("high", "low"), "blank": cs.not_blank("t"), "both": cs.implies(F.col("id") == 2, F.col("low").isNotNull())}).orderBy("id").collect()
    assert [r.violations for r in got] == [["range", "blank"], ["both"], ["blank"]]
    good, bad = cs.split(cs.checked(df, {"x": F.lit(True)}))
    assert good.count() == 3 and bad.count() == 0 and "violations" not in good.columns
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, ref string")
    parent = spark.createDataFrame([("a",), ("a",)], "id string")
    assert [r.id for r in cs.dangling(child, "ref", parent, "id").collect()] == [2]
    assert sorted((r.id, r.ref) for r in cs.set_null(child, "ref", parent, "id").collect()) == [(1, "a"), (2, None), (3, None)]
    assert [r.id for r in cs.cascaded(child, "ref", parent, "id").collect()] == [1]
    assert [(r.id, r.n) for r in cs.repeated_keys(parent, ["id"]).collect()] == [("a", 2)]


def test_evidence(spark):
    df = spark.createDataFrame([("1", ["Een  twee", "drie", " ", None], "xx EEN twee yy"), ("2", None, "x"), ("3", ["a"], None)], "id string, c array<string>, t string")
    got = df.select("id", evidence.verified(F.col("c"), F.col("t")).alias("v")).orderBy("id").collect()
    assert [(g.v.total, g.v.verified, g.v.missing) for g in got] == [(4, 1, ["drie", " ", None]), (0, 0, []), (1, 0, ["a"])]
    assert [(r.path, r.claim) for r in evidence.claim_issues(df, "id", "c", "t").where("id = '3'").collect()] == [("c[0]", "a")]


def test_stream(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "out")
    schema = "key string, at int, hash string"
    for rows in ([("a", 1, "x"), ("a", 2, "y")], [("a", 3, "y"), ("b", 1, "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        follow_changes(spark, spark.readStream.schema(schema).parquet(landed), root, ["key"], "at", "hash").awaitTermination()
    got = {(r.key, r["at"]): (r.action, r.version_no) for r in spark.read.parquet(root + "/versions").collect()}
    assert got == {("a", 1): ("created", 1), ("a", 2): ("changed", 2), ("a", 3): ("unchanged", 2), ("b", 1): ("created", 1)}


def test_null_keys(spark):
    """A null key is a key like others wherever states are compared."""
    old = spark.createDataFrame([(None, "t", "h"), ("1", "t", "h")], "key string, title string, hash string")
    new = spark.createDataFrame([(None, "u", "h", 1), (None, "v", "h", 2), ("2", "t", "h", 1)], "key string, title string, hash string, at int")
    got = {r.key: (r.title, r.action) for r in versions.merge_current(old, new, ["key"], "hash", "at").collect()}
    assert got == {None: ("v", "unchanged"), "1": ("t", "kept"), "2": ("t", "created")}
    stored = spark.createDataFrame([(None, "h", 3)], "key string, _fingerprint string, _version int")
    told = {r["at"]: (r.action, r.version_no) for r in versions.observed_actions(new.where("key is null"), ["key"], [F.col("at")], F.col("hash"), stored).collect()}
    assert told == {1: ("unchanged", 3), 2: ("unchanged", 3)}
    changes = spark.createDataFrame([(None, "w")], "key string, title string")
    assert {r.key: r.title for r in versions.updated(old, changes, ["key"]).collect()} == {None: "w", "1": "t"}
    assert sorted((str(r.key), r.title) for r in versions.upsert(old.select("key", "title"), changes, ["key"]).collect()) == [("1", "t"), ("None", "w")]
    assert [r.key for r in versions.without(old, changes, ["key"]).collect()] == ["1"]
    kids = spark.createDataFrame([(None, 1), ("1", 2)], "p string, n int")
    assert {r.key: len(r.kids) for r in feed.nested(old.select("key"), kids, "key", "p", ["n"], "kids").collect()} == {None: 0, "1": 1}


def test_failed_and_backfilled(spark):
    df = spark.createDataFrame([("1", "running", None), ("2", "running", "x")], "id string, status string, error string")
    errors = spark.createDataFrame([("1", "e" * 5000)], "id string, error string")
    got = {r.id: (r.status, len(r.error or "")) for r in versions.failed(df, errors, "id", "error").collect()}
    assert got == {"1": ("failed", 4000), "2": ("running", 1)}
    assert {r.id: r.error for r in versions.backfilled(df, {"error": "none"}).collect()} == {"1": "none", "2": "x"}


def test_batches_over_ranges(spark):
    """Numbers don't depend on how many tasks a group is split to."""
    df = spark.range(1000).selectExpr("case when id % 10 = 0 then null else 'd' end day", "id")
    got = runs.numbered_batches(df.repartition(7), ["day"], [F.col("id")], 25).collect()
    for day in (None, "d"):
        rows = sorted((r.id, r.batch_no) for r in got if r.day == day)
        assert [b for _, b in rows] == [i // 25 + 1 for i in range(len(rows))]
    assert len(got) == 1000 and runs.numbered_batches(df.limit(0), ["day"], [F.col("id")], 25).collect() == []


def test_merged_json(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [1.0]}}', '{"a": true}'), (None, '{"x": "é"}'), ("nope", None), ("[1]", "{}")], "l string, r string")
    assert [r.m for r in df.select(text.merged_json("l", "r").alias("m")).collect()] == ['{"a":true,"b":{"c":[1.0]}}', '{"x":"é"}', "{}", "{}"]


def test_leaves_and_sets(spark):
    df = spark.createDataFrame([("1", (["a", None], "t"), [("x", ["y"])]), ("2", None, None)], "id string, s struct<l:array<string>,v:string>, a array<struct<p:string,q:array<string>>>")
    got = sorted((r.id, r.path, r.value) for r in records.leaves(df, "id", ["s", "a"]).collect())
    assert got == [("1", "a[0].p", "x"), ("1", "a[0].q[0]", "y"), ("1", "s.l[0]", "a"), ("1", "s.v", "t")]
    sets = spark.createDataFrame([(["a", "b", "a"], ["b", "a"]), (["a"], None), (None, None), (["a"], ["b"])], "a array<string>, b array<string>")
    assert [r.x for r in sets.select(arrays.same_set(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True, False]


def test_stream_state(spark, tmp_path):
    """Steps and bases give the states of a single batch; a batch that runs twice and gaps in the numbers change nothing."""
    from oppflow.streaming.versions import apply_batch, numbers_in, state_before

    root, schema = str(tmp_path / "out"), "key string, at int, hash string"
    rows = [(f"k{i % 5}" if i % 7 else None, i, f"h{i // 4}") for i in range(40)]
    numbers = [0, 1, 2, 3, 5, 6, 7, 9]
    for n, batch in enumerate(numbers):
        part = spark.createDataFrame(rows[n * 5 : n * 5 + 5], schema)
        for _ in range(2 if batch in (3, 5) else 1):
            apply_batch(part, batch, root, ["key"], "at", "hash", steps=2)
    whole = versions.observed_actions(spark.createDataFrame(rows, schema), ["key"], [F.col("at"), F.col("hash")], F.col("hash"))
    want = sorted((str(r.key), r["at"], r.action, r.version_no) for r in whole.collect())
    assert sorted((str(r.key), r["at"], r.action, r.version_no) for r in spark.read.parquet(root + "/versions").collect()) == want
    last = {str(r.key): r.version_no for r in state_before(spark, root, 10, ["key"]).collect()}
    assert last == {k: max(v for q, _, _, v in want if q == k) for k in {w[0] for w in want}}
    assert min(numbers_in(spark, root + "/state/steps")) >= 7 and state_before(spark, root, 0, ["key"]) is None
