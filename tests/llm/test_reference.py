import math
from collections import Counter

from pyspark.sql import functions as F

from oppflow.llm import reference

PLACES = [(1, "Veldhoek", "Noord-Duin", []), (2, "Veldhoek", "Zuid-Duin", []), (3, "Klein-Boomdal", "Noord-Duin", ["De Krent"]), (4, "Boomdal", "Noord-Duin", None), (5, "Sint Anna Wierde aan de Rul", "Bos", []), (6, "Rëorn", "Bos", [])]
PROVINCES = [(1, "Noord-Duin", "ND"), (2, "Zuid-Duin", "ZD"), (3, "Bos", None)]


def run(spark, rows, places=PLACES, provinces=PROVINCES):
    df = spark.createDataFrame([(*r, 7) for r in rows], "id string, location string, province string, ref_id int")
    p = spark.createDataFrame(places, "place_id long, place_name string, province_name string, alt_names array<string>")
    q = spark.createDataFrame(provinces, "province_id long, province_name string, abbreviation string")
    return sorted((r.id, r.field_name, r.ref_id) for r in reference.located(df, p, q).collect())


def test_values(spark):
    cases = {
        "Boomdal": 4, "klein-boomdal": 3, "Kl. Boomdal": 3, "Kleinboomdal": 3, "1234 AB Bomdal": 4, "Boodmal (hybride)": 4, "de krent": 3, "St. Anna Wierde a/d Rul": 5, "Wierde": -1, "RIËORN": 6,
        "Elders": -1, "n.v.t.": -1, "Boomdal of Veldhoek": -1, "Noord-Duin": -1, "RÃ«iorn": 6,
    }
    got = run(spark, [(f"{i:02}", v, None) for i, v in enumerate(cases)])
    assert got == [(f"{i:02}", "location", n) for i, n in enumerate(cases.values())]


def test_settled_by_province(spark):
    rows = [("a", "Veldhoek", "prov. ZD"), ("b", "Veldhoek", "Noord Duin"), ("c", "Veldhoek", "Bos"), ("d", "Veldhoek", "Noord-Duin en Zuid-Duin"), ("e", "Veldhoek", None), ("a", "Veldhoek", "prov. ZD")]
    got = run(spark, rows)
    assert [x for x in got if x[1] == "location"] == [("a", "location", 2), ("b", "location", 1), ("c", "location", -1), ("d", "location", -1), ("e", "location", -1)]
    assert [x[2] for x in got if x[1] == "province"] == [2, 1, 3, -1]


def test_edges(spark):
    assert run(spark, [("a", " \u00a0", ""), ("b", None, None)]) == []
    assert run(spark, []) == []
    assert run(spark, [("a", "Boomdal", "Bos")], places=[], provinces=[]) == [("a", "location", -1), ("a", "province", -1)]
    assert run(spark, [("a", "woord " * 3000 + "Boomdal", None)]) == [("a", "location", 4)]


def test_words_with_more_than_one_error(spark):
    places = [
        (1, "Capelle aan den IJssel", "Zuid-Duin", []), (2, "Hoogezand-Sappemeer", "Noord-Duin", []), (3, "Amsterdam", "Noord-Duin", []), (4, "Nieuwerkerk aan den IJssel", "Zuid-Duin", []),
        (5, "Krimpen aan den IJssel", "Zuid-Duin", []), (6, "Rotterdam", "Zuid-Duin", []),
    ]
    cases = {
        "Capelle a/d IJsl": 1, "Capele ad IJsel": 1, "Hoogezand-Sappemr": 2, "Hoogezant-Sapemer": 2, "Amstrdm": 3, "Rotterdam, Amsterdam": -1, "IJssel": -1, "Krimpen": -1, "aan den IJssel": -1, "Utrecht": -1,
    }
    got = run(spark, [(f"{i:02}", v, None) for i, v in enumerate(cases)], places=places)
    assert got == [(f"{i:02}", "location", n) for i, n in enumerate(cases.values())]


def test_lookup_misses_nothing(spark):
    """Entries found are those that a comparison of every value with every entry finds, of which a leading word is met other than by a short form."""
    import random

    r = random.Random(4)
    parts = ["veld", "hoek", "boom", "dal", "klein", "groot", "sint", "anna", "aan", "den", "rijn", "wierde", "zand"]
    name = lambda: " ".join("".join(r.sample(parts, r.randint(1, 3))) if r.random() < 0.6 else r.choice(parts) for _ in range(r.randint(1, 4)))
    entries = sorted({name() for _ in range(120)})
    def typed(n):
        return " ".join(w[:k] + w[k + 1 :] if r.random() < 0.5 and (k := r.randrange(len(w))) and len(w) > 4 else w for w in n.split() if r.random() < 0.9)

    values = sorted({t for n in entries for _ in range(2) if (t := typed(n))})
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(entries)], "id long, name string")
    names = reference.entry_names(frame, "id", [F.array("name")])
    got = {x.value: list(x.ref_ids) for x in reference.rank_entries(spark.createDataFrame([(v,) for v in values], "value string"), names).collect()}
    listed = [(x.ref_id, list(x.words)) for x in names.collect()]
    count = Counter(w for _, ws in listed for w in ws)
    weights = {w: math.log(1 + len(listed) / n) for w, n in count.items()}

    def leads(ws):
        out, ahead, whole = {max(ws, key=lambda w: (len(w), weights[w], w))}, 0.0, sum(weights[w] for w in ws)
        for i, w in enumerate(sorted(ws, key=lambda w: (-weights[w], w))):
            if i == 0 or ahead <= reference.LOOKED_UP * whole:
                out.add(w)
            ahead += weights[w]
        return out

    leading = {(i, tuple(ws)): leads(ws) for i, ws in listed}
    for v in values:
        words = sorted(set(reference.tokens(v)))
        own = {w for w in words if w in weights}
        options = [(*m[:2], i, tuple(sorted(ws)), m[2]) for i, ws in listed if any(reference._alike(x, w) for x in words for w in leading[(i, tuple(ws))]) and (m := reference.match_entry(words, ws, weights, own))[0] > 0]
        assert got.get(v, []) == (reference._best_of(options) if options else []), v
