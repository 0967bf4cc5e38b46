import itertools
import re

from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oppflow.llm import personal, skipchain
from oppflow.llm.spelling import fold
from oppflow.llm.queries import personal_items


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    u, step, first = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    real = np.ones((1, 4), dtype=bool)
    p, z, pairs = skipchain.marginals(u, real, step, first)
    total, want, want_pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(first[path[0]] + sum(u[0, t, y] for t, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, y in enumerate(path):
            want[t, y] += w
        for a, b in zip(path, path[1:]):
            want_pairs[a, b] += w
    assert np.allclose(p[0], want / total) and np.isclose(z, np.log(total)) and np.allclose(pairs, want_pairs / total)


def test_skip_edges_carry_a_label():
    field = skipchain.Field(["O", "B-x"], {}, np.zeros((5, 0, 2)), np.zeros((2, 2)), np.zeros(2), np.array([[1.2, 1.2], [0.0, 0.0]]))
    u = np.array([[0.0, 3.0], [0.0, -0.5], [0.0, -0.5]])
    lengths, edge = np.array([1, 1, 1]), np.array([[0, 1]])
    assert skipchain.decode(field, u, lengths, np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=int)).tolist() == [1, 0, 0]
    assert skipchain.decode(field, u, lengths, edge, np.array([0])).tolist() == [1, 1, 0]
    assert skipchain.decode(field, u, lengths, edge, np.array([1])).tolist() == [1, 0, 0]  # a sort without reward


def test_messages_on_a_tree_are_exact():
    """Two chains and one edge have no loop, so that the beliefs after enough rounds are the marginals by enumeration."""
    rng = np.random.default_rng(5)
    field = skipchain.Field(["O", "B-x", "I-x"], {}, np.zeros((5, 0, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), np.array([[0.7, 1.5], [0.0, 0.0]]))
    u, lengths, edges = rng.normal(size=(4, 3)), np.array([2, 2]), np.array([[1, 2]])
    got = skipchain.chain_marginals(field, skipchain.passed(field, u, lengths, edges, np.array([0]), rounds=60), lengths)
    kind, want, total = field.kind_of, np.zeros((4, 3)), 0.0
    for y in np.ndindex(3, 3, 3, 3):
        w = sum(u[t, k] for t, k in enumerate(y)) + field.first[y[0]] + field.first[y[2]] + field.step[y[0], y[1]] + field.step[y[2], y[3]]
        w = np.exp(w + (field.agree[0, kind[y[1]]] if kind[y[1]] == kind[y[2]] else 0))
        total += w
        for t, k in enumerate(y):
            want[t, k] += w
    assert np.allclose(got, want / total, atol=1e-3)


def test_skip_potentials_are_fitted():
    """A type that says nothing by itself takes the label at the other end of its edges, if the fit says that ends agree."""
    chains, gold, edges = [], [], []
    for i in range(40):
        label = 1 if i % 2 else 0
        chains += [[0 if label else 1], [2]]
        gold += [[label], [label]]
        edges.append((2 * i, 0, 2 * i + 1, 0, 0))
    field = skipchain.fit(chains, gold, [["yes"], ["no"], ["vague"]], ["O", "B-x"], edges)
    assert (field.agree[0] > 0.5).all() and (field.agree[1] == 0).all()
    u = skipchain.flat_unary(np.stack([field.type_scores([f]) for f in ("yes", "no", "vague")]), np.array([0, 2, 1, 2]), np.array([1, 1, 1, 1]))
    assert skipchain.decode(field, u, np.ones(4, dtype=int), np.array([[0, 1], [2, 3]]), np.array([0, 0])).tolist() == [1, 1, 0, 0]


def test_number_forms():
    t = personal.number_type
    assert t("06-12345678") == "#0:10:-" and t("+31 6 1234 5678") == "#+31:9:" and t("+31 (0)20-1234567") == "#+31:9:(-" and t("0031 20 123 4567") == "#0031:9:"
    assert t("111222333").endswith(":eleven") and not t("123456789").endswith(":eleven") and t("2024") == "#19:4:"
    assert personal.mail_type("a.b@c.nl") == "@@:1" and personal.mail_type("a [at] b [dot] c (punt) nl") == "@(:2" and personal.mail_type("a&#64;b") == "@&:0"


@pytest.fixture(scope="module")
def items(spark, data):
    return personal_items(spark, data).cache()


def test_found_in_tables(spark, data, items):
    rows = items.where("field_name = 'evidence_snippets.text'").collect()
    kinds = {i.kind for r in rows for i in r["items"]}
    assert kinds == set(personal.KINDS)
    for r in rows:
        for i in r["items"]:
            part = r.text[i.start : i.end]
            assert part and (i.kind != "email" or "@" in part or "at" in part)
    phones = items.where("field_name like '%contact_information.phone'").collect()
    assert all(not r["items"] for r in phones if r.text.startswith("vacaturenummer"))
    plain = [r for r in phones if re.fullmatch(r"[+(0][\d ().\-]{9,}", r.text)]
    assert plain and all([(i.kind, i.start) for i in r["items"]] == [("phone", 0)] for r in plain)


def test_contact_fields(items):
    emails = items.where("field_name like '%contact_information.email'").collect()
    plain = [r for r in emails if re.fullmatch(r"[\w.+-]+@[\w.-]+", r.text)]
    assert plain and all([(i.kind, i.start) for i in r["items"]] == [("email", 0)] for r in plain)


def test_spans_are_trimmed():
    labels = personal.LABELS
    name = [labels.index("B-person_name")] + [labels.index("I-person_name")] * 9
    toks = personal.tokens("GIS-specialist, C.A. Jansen")
    assert personal.spans(toks, name[: len(toks)]) == [("person_name", 16, 27)]
    toks = personal.tokens("mevrouw van Jan Smit,")
    assert personal.spans(toks, name[: len(toks)]) == [("person_name", 12, 20)]
    toks = personal.tokens("Adviesbureau Jan Smit")
    assert personal.spans(toks, [0, *name[:2]]) == []
    assert [t[0] for t in personal.tokens("Jan Smit <jan [at] post [dot] nl>")][2:4] == ["<", "@(:1"]


def test_masked_round_trip(items):
    masked = {(r.field_name, r.record_id): r.masked for r in personal.masked(items).collect()}
    for r in items.collect():
        out, at = "", 0
        for i in sorted(r["items"], key=lambda i: i.start):
            out += r.text[at : i.start] + f"[{i.kind.upper()}]"
            at = i.end
        assert masked[(r.field_name, r.record_id)] == out + r.text[at:]


def test_edges(spark, items, data):
    finder = personal.fit_finder([], [])
    assert finder.find([None, "", "Bel 06-12345678"])[:2] == [[], []]
    empty = spark.createDataFrame([], "record_id string, text string")
    assert personal.found_items([("x", empty)], finder).collect() == []
    rows = spark.createDataFrame([("a", None, 1), ("b", "", 1), ("c", "x " * 200_000, 1), ("c", "x " * 200_000, 1)], "record_id string, text string, items int")
    got = personal.found_items([("x", rows.select("record_id", "text"))], finder).collect()
    assert [r.record_id for r in got] == ["c"]


@pytest.fixture(scope="module")
def texts():
    data = "/root/testdata/sf0.01"
    read = lambda name, columns: pq.read_table(f"{data}/{name}.parquet", columns=columns).to_pylist()
    records = read("structured_opportunities", ["raw_opportunity_id", "contact_information", "client_name", "location", "title"])
    own = {r["raw_opportunity_id"]: r["contact_information"]["name"] for r in records if r["contact_information"]}
    pages = [(r["raw_content"], own.get(r["id"])) for r in read("raw_opportunities", ["id", "raw_content"]) if r["raw_content"]]
    snippets = sorted({r["text"] for r in read("evidence_snippets", ["text"]) if r["text"]})
    contacts = [r["contact_information"] for r in records if r["contact_information"]]
    names = [c["name"] for c in contacts if c["name"]]
    fields = [c[k] for k in ("email", "phone") for c in contacts if c[k]]
    no_people = sorted({r[k] for k in ("client_name", "location", "title") for r in records if r[k]})
    return snippets, pages, fields, names, no_people


@pytest.fixture(scope="module")
def finder(texts):
    snippets, pages, fields, names, no_people = texts
    return personal.fit_finder(snippets + pages[:225] + fields, names, no_people)


def test_first_names_held_out(texts):
    """Fitted without every text in which one of a third of the first names stands; the names with them are found all the same."""
    snippets, pages, fields, names, no_people = texts
    known = sorted(personal.known_first_names(names))
    out = known[::3]
    has = re.compile(r"\b(?:" + "|".join(out) + r")\b")
    kept = lambda t: not has.search(fold(t))
    seen = [t for t in snippets if kept(t)] + [p for p in pages if kept(p[0]) and kept(p[1] or "")] + [t for t in fields if kept(t)]
    finder = personal.fit_finder(seen, [n for n in names if kept(n)], [t for t in no_people if kept(t)])
    assert not finder.first_names & set(out)
    met = whole = 0
    tested = [t for t in [*snippets, *(p[0] for p in pages)] if not kept(t)]
    assert len(tested) > 50
    for text, items in zip(tested, finder.find(tested)):
        starts = {a for k, a, _ in items if k == "person_name"}
        for at, stretch in personal.stretches(text):
            toks = personal.tokens(stretch, at)
            for k, a, b in personal.spans(toks, personal.weak_spans(toks, set(out))):
                if k == "person_name" and has.search(fold(text[a:b])):
                    whole += 1
                    met += a in starts
    assert whole > 60 and met >= 0.95 * whole, (met, whole)


def test_unlike_the_weak_labels(finder):
    """Names that the weak labels don't know, with titles and marks outside."""
    cases = {
        "Contact: Piet Jansen": ["Piet Jansen"],
        "Contactpersoon: Jan de Vries": ["Jan de Vries"],
        "De heer K. Bakker belt": ["K. Bakker"],
        "<dt>Contactpersoon</dt><dd>Willemijn Oudenaller</dd>": ["Willemijn Oudenaller"],
        "<td>G. Verhoef</td>": ["G. Verhoef"],
        "Mevrouw Anouk Brinkhorst leidt het team. Vragen? Brinkhorst is bereikbaar.": ["Anouk Brinkhorst", "Brinkhorst"],
    }
    wrong = {t: got for t, want in cases.items() if (got := [t[a:b] for k, a, b in finder.find([t])[0] if k == "person_name"]) != want}
    assert not wrong
    weak = [personal.weak_spans(personal.tokens(t), finder.first_names) for t in ("Contact: Piet Jansen", "Contactpersoon: Jan de Vries")]
    assert not any(map(any, weak))


def test_skip_edges_decide(finder):
    """Surnames that recur alone, as they are or misspelled, are found by their edges only."""
    firsts = sorted(finder.first_names)
    people = [f"{firsts[i % len(firsts)].title()} {a}{b}" for i, (a, b) in enumerate(itertools.product(("Ouden", "Brink", "Zander", "Hoogen", "Wester", "Linden"), ("aller", "horst", "zijl", "dijker", "beemd")))]
    lone = "<p>Contactpersoon: {}</p>\n<p>De planning staat nog niet vast. Voor het overleg belt {} met het team.</p>"
    letters = lambda w: w[:3] + w[4:]
    made = [lone.format(p, p.split()[1]) for p in people] + [lone.format(p, letters(p.split()[1])) for p in people]
    off = personal.Finder(replace(finder.model, agree=np.zeros_like(finder.model.agree)), finder.first_names)
    found = lambda f: sum(len(x) == 2 for x in f.find(made))
    with_, without = found(finder), found(off)
    assert len(people) > 20 and with_ >= 0.5 * len(made) and without <= 0.1 * with_, (with_, without, len(made))


def test_edges_left_out_change_nothing(finder, texts):
    """Only edges that could but confirm are left out: with none left out the items are the same."""
    some = [p[0] for p in texts[1][:120]] + texts[0][:300]
    every = personal.Finder(finder.model, finder.first_names, sure=1.1)
    assert finder.find(some) == every.find(some)


def test_every_form_alone_in_its_block():
    names = [f"{a} {b}" for a in ("Saskia", "Joris", "Willemijn") for b in ("Smit", "de Boer", "van der Molen")]
    r = np.random.default_rng(3)
    people = [f"{i}. {p} {n}".replace("  ", " ") for i in "ABCDEFGHIJ" for p in ("", "de", "van den", "ter") for n in ("Molenveld", "Broekhoek")] + names
    mails = ["jan.smit@post.nl", "s.boer [at] post [dot] nl", "i.smit (apenstaartje) post (punt) nl"]
    other = ["<p>De opdracht duurt een jaar.</p>", "<li>Ervaring met Oracle en Java</li>", "<h2>Over de opdracht</h2>", "We zoeken een ontwikkelaar"]
    streets = ["Kerkstraat 5", "Oude Molenweg 12", "Stationsplein 3a"]
    around = ["<dt>Contactpersoon</dt><dd>{}</dd>", "<dd>{}</dd>", "<td>{}</td>", "Contact: <strong>{}</strong>", "Neem contact op met {}."]
    texts = [f"{r.choice(around).format(p)}\n{r.choice(other)}\n<td>{r.choice(mails)}</td>\n<p>Tel. 06-12345678</p>\n<td>{r.choice(streets)}</td>" for p in people + names * 4 for _ in range(3)]
    finder = personal.fit_finder(texts, names * 2)
    forms = [
        ("person_name", "C. de Schiekveld"), ("person_name", "C. van den Schiekveld"), ("person_name", "C. Schiekveld"), ("person_name", "Saskia Smit"),
        ("email", "jan.smit@post.nl"), ("email", "s.boer [at] post [dot] nl"), ("email", "i.smit (apenstaartje) post (punt) nl"),
        ("phone", "06-12345678"), ("address", "Kerkstraat 5"),
    ]
    for kind, form in forms:
        text = f"<dd>{form}</dd>"
        assert finder.find([text]) == [[(kind, 4, 4 + len(form))]], form
