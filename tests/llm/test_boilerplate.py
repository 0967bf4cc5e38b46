import numpy as np
import pytest

from oppflow.llm import boilerplate, boosting
from oppflow.llm.dom import LeafText, Pages, decode, labelling
from oppflow.sources.tables import read_table


def test_boosting_learns_an_exclusive_or():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x[:2000], y[:2000], trees=30, depth=3)
    assert ((model.score(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95
    assert boosting.fit(x[:0], y[:0]).score(x[:3]).shape == (3,)


def test_pages_keep_line_numbers():
    pages = Pages()
    pages.add("<html><head><title>t</title><script>a<b\n</script></head>\n<body><p>een<p>twee\ndrie\n<ul><li>x<li>y</ul><p hidden>weg</p><table><tr><td>a<td>b<tr><td>c</table>&nbsp;\n<div style='display: none'>n</div>z", "html")
    assert list(zip(pages.line, pages.text)) == [(3, "een"), (3, "twee"), (4, "drie"), (5, "x"), (5, "y"), (5, "a"), (5, "b"), (5, "c"), (6, "z")]
    pages = Pages()
    pages.add("a\n\n b \r\n", "text")
    pages.add(None, "html")
    assert list(zip(pages.line, pages.text)) == [(1, "a"), (3, "b")] and pages.first_leaf == [0, 2, 2]


def best(pages, e, leaf):
    top = None
    n = len(pages.tag)
    for mask in range(2**n):
        keep = [bool(mask >> i & 1) for i in range(n)]
        if any(keep[i] and pages.parent[i] >= 0 and not keep[pages.parent[i]] for i in range(n)) or not keep[0]:
            continue
        worth = sum(e[i] for i in range(n) if keep[i]) + sum(max(0, s) for s, o in zip(leaf, pages.of) if keep[o])
        top = worth if top is None else max(top, worth)
    return top


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(2)
    pages = Pages()
    pages.add("<body><div><p>a</p><p>b</p></div><nav><ul><li>c</li><li>d</li></ul></nav></body>", "html")
    for _ in range(60):
        e, leaf = rng.normal(size=len(pages.tag)), rng.normal(size=len(pages.text))
        stays, kept = labelling(pages, e, leaf), decode(pages, e, leaf)
        assert all(stays[i] <= (pages.parent[i] < 0 or stays[pages.parent[i]]) for i in range(len(e)))
        assert kept.tolist() == [bool(stays[o] and s > 0) for o, s in zip(pages.of, leaf)]
        got = e[stays].sum() + leaf[kept].sum()
        assert abs(got - best(pages, e, leaf)) < 1e-9


@pytest.fixture(scope="module")
def tables(spark):
    data = "/root/testdata/sf0.01"
    return {t: read_table(spark, data, t) for t in ("raw_opportunities", "raw_opportunity_versions", "structured_opportunities")}


def test_held_out_accuracy(spark, tables):
    records = tables["structured_opportunities"].dropDuplicates(["raw_opportunity_id"]).collect()
    pages = {r.id: (r.raw_content, r.raw_format) for r in tables["raw_opportunities"].where("raw_content is not null").collect()}
    rows = sorted((r for r in records if r.raw_opportunity_id in pages and r.description), key=lambda r: r.raw_opportunity_id)
    marks = [boilerplate.record_marks(r.asDict(recursive=True)) for r in rows]
    contents = [pages[r.raw_opportunity_id] for r in rows]
    half = len(rows) // 2
    model = boilerplate.fit_pages(contents[:half], marks[:half])
    right = wrong = 0
    for content, m in zip(contents[half:], marks[half:]):
        one = Pages()
        one.add(*content)
        y = boilerplate.weak_labels(one, 0, m)
        if y is not None:
            got = set(boilerplate.main_lines(one, model, LeafText(model.words, model.lines))[0])
            want = {one.line[i] for i in np.flatnonzero(y)}
            right += len(got & want)
            wrong += len(got ^ want)
    assert right > 500 and wrong < 0.02 * right


def test_held_out_sites(tables):
    """Fitted to the pages of half of the sites, right on those of the other half."""
    records = tables["structured_opportunities"].dropDuplicates(["raw_opportunity_id"]).collect()
    pages = {r.id: (r.raw_content, r.raw_format, r.source_id) for r in tables["raw_opportunities"].where("raw_content is not null").collect()}
    rows = sorted((r for r in records if r.raw_opportunity_id in pages and r.description), key=lambda r: r.raw_opportunity_id)
    sites = sorted({pages[r.raw_opportunity_id][2] for r in rows})
    half = set(sites[::2])
    seen = [r for r in rows if pages[r.raw_opportunity_id][2] in half]
    other = [r for r in rows if pages[r.raw_opportunity_id][2] not in half]
    marks = lambda r: boilerplate.record_marks(r.asDict(recursive=True))
    model = boilerplate.fit_pages([pages[r.raw_opportunity_id][:2] for r in seen], [marks(r) for r in seen])
    right = wrong = 0
    for r in other:
        one = Pages()
        one.add(*pages[r.raw_opportunity_id][:2])
        y = boilerplate.weak_labels(one, 0, marks(r))
        if y is not None:
            got = set(boilerplate.main_lines(one, model, LeafText(model.words, model.lines))[0])
            want = {one.line[i] for i in np.flatnonzero(y)}
            right += len(got & want)
            wrong += len(got ^ want)
    assert len(sites) > 10 and right > 500 and wrong < 0.05 * right, (right, wrong)


def test_edges(spark, tables):
    raw, records = tables["raw_opportunities"], tables["structured_opportunities"]
    none = boilerplate.training_sample(raw.limit(0), records.limit(0))
    model = boilerplate.training_sample(raw, records, most=60)
    schema = "id string, raw_content string, raw_format string, lines int"
    df = spark.createDataFrame([("a", None, "html", 1), ("b", "", None, 1), ("c", "woord " * 200_000, "text", 1), ("d", "<p>x", "HTML", 1), ("d", "<p>x", "HTML", 1)], schema)
    for m in (none, model):
        got = boilerplate.main_content({"t": df}, m).collect()
        assert sorted(r.record_id for r in got) == ["a", "b", "c", "d"]
        assert all(r.lines == [] for r in got if r.record_id in "ab")
        assert boilerplate.main_content({"t": df.limit(0)}, m).collect() == []
    lines = boilerplate.main_content({"raw_opportunities": raw}, model)
    text = boilerplate.main_text(raw, lines, "raw_opportunities").where("main_text <> ''").count()
    assert text > 250
