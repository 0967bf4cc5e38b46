import random

from hypothesis import given, settings, strategies as st

from oppflow.llm import components, names, segments
from oppflow.llm.spelling import banded_distance, fold, is_short_for, mend


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 3))
def test_banded_distance(a, b, k):
    assert banded_distance(a, b, k) == min(osa(a, b), k + 1)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_segment_pairs_miss_nothing(spark):
    r = random.Random(8)
    strings = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(220)})
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for k in (1, 2):
        got = {(x.a, x.b) for x in segments.segment_pairs(df, k).collect()}
        fit = [s for s in strings if len(s) > k]
        assert got == {(a, b) for a in fit for b in fit if a < b and levenshtein(a, b) <= k}
        half = spark.createDataFrame([(s,) for s in strings[::2]], "s string")
        two = {(x.a, x.b) for x in segments.segment_pairs(half, k, df).collect()}
        assert two == {(a, b) for a in strings[::2] for b in fit if len(a) > k and levenshtein(a, b) <= k}


def test_components(spark):
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(60)], "node string")
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(39)] + [("n050", "n045")], "a string, b string")
    got = {r.node: r.component for r in components.components(nodes, edges).collect()}
    assert len(got) == 60 and all(got[f"n{i:03}"] == "n000" for i in range(40)) and got["n050"] == "n045" and got["n059"] == "n059"


def test_spellings_of_one_client(spark):
    groups = [
        ["Waterschap Grootveld", "waterschap grootveld", "de waterschap Grootveld", "Watersch. Grootveld", "Grootveld, waterschap", "Grootveld (WS)", "Waterschap Grotoveld", "WaterschapGrootveld", "Waterschap Grootveld - afd. Inkoop", " Waterschap  Grootveld."],
        ["Hogeschool Grootveld", "HOGESCHOOL GROOTVELD"],
        ["Veiligheidsregio West-Boomdal", "Veil.regio West-Boomdal"],
        ["Veiligheidsregio Oost-Boomdal"],
        ["Landelijk Bureau Werkzaken", "LBWZ", "L.B.W.Z.", "Landelijk Bureau Werkzaken (LBWZ)", "Werkzaken, Landelijk Bureau", "Land. Bureau Werkzaken"],
    ]
    nobody = ["", "-", "n.v.t.", "onbekend", " ", "Diverse opdrachtgevers", None]
    rows = [(v, 1) for g in groups for v in g for _ in range(2)] + [(v, 1) for v in nobody]
    df = spark.createDataFrame(rows, "client_name string, client int")
    got = {(r.name_a, r.name_b) for r in names.linked_pairs(df).collect()}
    want = {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}
    assert got == want, (got - want, want - got)
    assert names.linked_pairs(df.limit(0)).collect() == []


def test_two_words_typed_wrong(spark):
    pairs = [
        ("Waterschap Grootveld", "Watreschap Grotoveld"),  # two swaps
        ("Hogeschool Boomdal", "Hogseschool Bomodal"),  # an edit and a swap
        ("Omgevingsdienst Kleinwaard", "Xmgevingsdienst Kleiwnaard"),  # another order of the words
        ("Regionale Brandweer Zuiderhoek", "Rgeionale Brandweer Zuidrehoek"),
        ("GGD Zandmeerland", "GGD Aandmeerland"),  # one word, another order
        ("Provincie Berkelstroom", "provincieberkelstroom"),  # a space lost, another order
    ]
    df = spark.createDataFrame([(v,) for p in pairs for v in p], "client_name string")
    assert all(names.same_but_typed(*(" ".join(names.parse_name(v)[0]) for v in p)) for p in pairs)
    got = {(r.name_a, r.name_b) for r in names.linked_pairs(df).collect()}
    assert got == {tuple(sorted(p)) for p in pairs}


def test_spelling_helpers():
    assert mend("RiÃ«l") == "Riël" and fold("DÉ\u200bJÀ") == "deja"
    assert is_short_for("gzd", "gezondheidsdienst") and not is_short_for("gzd", "zorg") and not is_short_for("weg", "weg")


def test_typed_pairs_miss_nothing(spark):
    r = random.Random(3)
    strings = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(400)})
    got = {(x.a, x.b) for x in segments.typed_pairs(spark.createDataFrame([(s,) for s in strings], "s string")).collect()}
    fit = [s for s in strings if len(s) > 1]
    assert got == {(a, b) for a in fit for b in fit if a < b and osa(a, b) <= 1}
    assert segments.typed_pairs(spark.createDataFrame([], "s string")).collect() == []


def test_lost_links(spark):
    """A first letter typed wrong, which moves the word, errors in two words, and short words."""
    pairs = [
        ("Waterschap Amstelland", "Waterschap Zmstelland"), ("Gemeente Autrecht", "Gemeente Utrecht"),
        ("Hgoeschool Grotoveld", "Hogeschool Grootveld"), ("Waterschap Rijn", "Waterschap Rjin"), ("Gemeente Ede", "Gemeente Edr"),
    ]
    apart = ["Gemeente Epe", "Epe gemeente zuid", "Stichting Epe", "Stichting Ede", "Veiligheidsregio West-Gingfrurveld", "Veiligheidsregio West-Groongfroelsveld"]
    df = spark.createDataFrame([(v,) for p in pairs for v in p] + [(v,) for v in apart], "client_name string")
    assert {(r.name_a, r.name_b) for r in names.linked_pairs(df).collect()} == set(pairs)


def test_typed_links_against_brute_force(spark):
    r = random.Random(11)
    heads = ["gemeente", "waterschap", "hogeschool", "veiligheidsregio", "ggd"]
    word = lambda: "".join(r.choice(("ka", "lo", "mi", "ru", "ste", "wa", "el", "burg")) for _ in range(r.randint(2, 4)))

    def typed(w):
        i = r.randrange(len(w) - 1)
        return r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice("abz") + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "q" + w[i:]))

    plain = [[r.choice(heads), word()] + ([word()] if r.random() < 0.3 else []) for _ in range(900)]
    forms = {" ".join(sorted(p)) for p in plain} | {" ".join(sorted(typed(w) if r.random() < 0.6 else w for w in p)) for p in plain for _ in range(2)}
    forms = sorted(forms)[:2000]
    strings = spark.createDataFrame([(f,) for f in forms], "s string")
    words = strings.selectExpr("explode(array_distinct(split(s, ' '))) s").distinct()
    links = {(x.a, x.b) for x in names._typed_links(strings, names.near_words(words)).collect()}
    short = {(x.a, x.b) for x in names._short_word_pairs(strings).collect()}
    assert links - short == {(a, b) for i, a in enumerate(forms) for b in forms[i + 1 :] if names.same_but_typed(a, b)} - short


def test_candidates_of_a_shared_word(spark):
    """Fifty thousand names that share their first word meet only those that one edit makes alike."""
    made = spark.range(50_000).selectExpr("concat('gemeente ', translate(substring(md5(cast(id as string)), 1, 9), '0123456789', 'ghijklmnop')) s").distinct()
    words = made.selectExpr("explode(split(s, ' ')) s").distinct()
    near = names.near_words(words)
    assert names._word_pairs(made, near).count() < 1000
    probes = segments.typed_pairs(words)
    assert probes.count() < 1000
