import random
from datetime import datetime

import pytest

from oppflow.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, delivered_at timestamp_ntz, source_id string, source_reference string, content_hash string, source_status string, pair string, n int"


def brute(rows):
    norm = lambda s, f: None if s is None else f(s.strip())
    by = {}
    for no, at, sid, ref, h, st, *_ in rows:
        if no is None:
            continue
        key = (norm(sid, str), norm(ref, str.upper))
        value = (at or datetime.min, "" if h is None else "=" + norm(h, str.lower), "" if st is None else "=" + norm(st, str.lower))
        old = by.setdefault(no, {}).get(key)
        if old is None or value > old:
            by[no][key] = value
    numbers, out = sorted(by), set()
    for a, b in zip(numbers, numbers[1:]):
        for key in by[a].keys() | by[b].keys():
            x, y = by[a].get(key), by[b].get(key)
            if x is None or y is None:
                out.add((b, *key, "added" if x is None else "removed"))
            elif x[1:] != y[1:]:
                out.add((b, *key, "changed"))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [
        (
            r.choice([1, 2, 3, 5, None]), r.choice([datetime(2025, 1, d) for d in (1, 2, 3)] + [None]), r.choice(["s1", "s2", None]), r.choice(["a1", " A1\t", "b", "B ", "c", "", None]),
            r.choice(["x", "X ", "y", None, ""]), r.choice(["active", " Active", "closed", None]), "clash", 1,
        )
        for _ in range(150)
    ]
    got = [tuple(x) for x in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_hot_key_and_repeats(spark):
    rows = [(n, datetime(2025, 1, 1), "s", "hot", "h", "active", "", 0) for n in (1, 2) for _ in range(500)] + [(2, datetime(2025, 1, 2), "s", "hot", "new", "active", "", 0)]
    assert [tuple(x) for x in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()] == [(2, "s", "HOT", "changed")]


def test_empty(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA)).collect() == []
