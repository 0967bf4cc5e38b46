import numpy as np
import pytest
from pyspark.sql import functions as F

from oppflow.llm import mixture


def test_quotas_are_exact():
    for quotas in ([40, 7, 0, 13], [1, 1], [1000, 3, 77]):
        out = mixture.split_quotas(quotas, 7, 3)
        assert out.sum(axis=0).tolist() == quotas and out.sum(axis=1).max() - out.sum(axis=1).min() <= 1 and out.min() >= 0
    shares = np.array([mixture.split_quotas([50, 50], 4, s)[0, 0] for s in range(200)]) / 25
    assert 0.45 < shares.mean() < 0.55


def test_bucket_bound():
    assert mixture.buckets_for(10) == 1024 and mixture.buckets_for(10**8) == 100_000 and mixture.buckets_for(10**7) == 10_000
    assert mixture.buckets_for(0) == 1024 and mixture.buckets_for(10**12) == 1_000_000


def test_uses_meet_quotas(spark):
    """Whole passes and part of one more, each use in one shard, for more targets than the driver would plan one by one."""
    sources = [f"s{i:04}" for i in range(1200)]
    blocks = spark.createDataFrame([(s, b, 10 + b) for s in sources for b in range(4)], "source string, block long, tokens long")
    quotas = spark.createDataFrame([(s, 46, 3, 46 * (i % 3) + (i % 40)) for i, s in enumerate(sources)], "source string, size long, max_repeats int, quota long")
    uses = mixture.block_uses(blocks, quotas, 7)
    got = {r.source: r.t for r in uses.join(blocks, ["source", "block"]).groupBy("source").agg(F.sum(F.coalesce("left", "tokens")).alias("t")).collect()}
    assert got == {s: 46 * (i % 3) + i % 40 for i, s in enumerate(sources) if 46 * (i % 3) + i % 40}
    placed = mixture.shards_of_uses(uses, 5, 7).join(uses, ["source", "use_no"], "full_outer").collect()
    assert len(placed) == uses.count() and all(r.shard is not None and r.block is not None for r in placed)
    sizes = [sum(r.shard == k for r in placed) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"woord nummer {i} " * (1 + i % 5), "big" if i % 3 else "mid", 1) for i in range(900)] + [(1000 + i, "klein woord " * 3, "small", 1) for i in range(9)] + [(2000, None, "small", 1), (2001, "x", None, 1), (2002, "y", "other", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, bucket int")


def test_shares_and_repeats(spark, docs):
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.35, 2), ("small", 0.05, 4), ("none", 0.2, 3), (None, 0.5, 1), ("off", None, 2)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(docs, targets, shards=5).cache()
    got = {r.source: r for r in mixture.mixture_shares(mixed, targets).collect()}
    for s, share in (("big", 0.6), ("mid", 0.35), ("small", 0.05)):
        assert abs(got[s].actual_share - share) < 0.01, got
    assert got["none"].tokens == 0 and got["small"].most_repeats <= 4 and got["big"].most_repeats == 1
    uses = mixed.groupBy("doc_id", "source").count().collect()
    assert all(r["count"] <= {"big": 1, "mid": 2, "small": 4}[r.source] for r in uses)
    assert mixed.select("doc_id", "repeat_no").distinct().count() == mixed.count()
    assert mixed.select("shard", "position").distinct().count() == mixed.count()
    again = mixture.mix(docs, targets, shards=5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_empty(spark, docs):
    targets = spark.createDataFrame([("big", 0.6, 1)], "source string, target_share double, max_repeats int")
    assert mixture.mix(docs.limit(0), targets).collect() == []
    none = mixture.mix(docs, targets.limit(0))
    assert none.collect() == [] and mixture.mixture_shares(none, targets.limit(0)).collect() == []


def test_bounds(spark, data):
    from oppflow.llm.queries import QUERIES

    rows = QUERIES["p7_bounds"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 11 and all(r.within_cap and r.reached for r in rows)
