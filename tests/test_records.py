import pandas as pd
from pyspark.sql import functions as F, types as T

from oppflow.operators import records


def test_reservation(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    ledger = spark.createDataFrame([("a", "succeeded", "1"), ("a", "failed", None), ("b", "running", None), (None, "succeeded", "2")], "k string, status string, result_id string")
    assert {r.k: r.reservation for r in records.reserved(work, ledger, "k").collect()} == {"a": "skip", "b": "reset", "c": "new", None: "new"}


def test_closing(spark):
    now = spark.createDataFrame([("s", "1", "active"), ("s", "2", "active"), ("s", "3", "closed"), ("t", "1", "active")], "src string, ref string, source_status string")
    seen = spark.createDataFrame([("s", "1")], "src string, ref string")
    counts = spark.createDataFrame([("s", 60, 80), ("t", 10, 80)], "src string, found int, previous int")
    got = {(r.src, r.ref): r.source_status for r in records.closed_missing(now, seen, counts, ["src", "ref"], "src").collect()}
    assert got == {("s", "1"): "active", ("s", "2"): "closed", ("s", "3"): "closed", ("t", "1"): "active"}


def test_typed_json(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 1, "z": 2}',), ("nope",), (None,)], "j string")
    got = records.typed_json(df, "j", schema, required=["b"]).collect()
    assert [r.issues for r in got] == [[], ["unknown:z", "missing:b"], ["not_json"], ["not_json"]]
    assert got[0].record.a == 1 and got[2].record is None
    flat = records.flattened(records.typed_json(df.limit(1), "j", schema), "record", [], {"b": (["y"], "other")}).first()
    assert tuple(flat) == (1, "other")


def test_contents(spark):
    df = spark.createDataFrame([("<p>a <b>b</b></p>", "html"), ('{"b":1, "a":2}', "json"), (" a\n b", "text"), (None, "html")], "c string, k string")
    assert [r.x for r in df.select(records.normalized_content(F.col("c"), F.col("k")).alias("x")).collect()] == ["a b", '{"a":2,"b":1}', "a b", None]
    texts = spark.createDataFrame([("w \x00ord " * 30,), ("kort",), (None,), ("x" * 200,)], "c string").select(records.prepared_document(F.col("c"), 190).alias("p")).collect()
    assert [r.p.error for r in texts] == [None, "unreadable", "unreadable", "too_long"] and texts[0].p.readable == 120 and texts[0].p.text.startswith("w ord w ord")


def test_model_steps(spark):
    df = spark.createDataFrame([("h1", "a"), ("h2", "b")], "h string, t string")
    recorded = spark.createDataFrame([("h1", "out")], "h string, answer string")
    assert {r.h: r.answer for r in records.with_recorded(df, recorded, "h").collect()} == {"h1": "out", "h2": None}

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"h": batch.h, "n": batch.t.str.len()})

    assert sorted(map(tuple, records.with_model(df, answer, "h string, n long").collect())) == [("h1", 1), ("h2", 1)]
