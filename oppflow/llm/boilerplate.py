"""The main text of web pages: which lines belong to the page's own subject.

Gradient-boosted trees score every DOM node (``dom``); a tree-wise decoding then
takes the best labelling without contradictions, so that nothing inside a
rejected container is kept and no container is kept empty.

No one has labelled the pages, but many have a structured record: the title,
description, requirements and contact details that were read from the page mark
lines as main text. Lines between the first and the last such mark in the
smallest container around all marks are main text as well, except what invites
to use the site (``INVITES``); everything else on such a page is not. The trees
and the word scores are fitted to a sample of at most ``TRAIN_PAGES`` such pages,
chosen by a hash of the id; it is the only part that doesn't see all data.

Equal contents are parsed once: contents are told apart by their SHA-256, and
the line numbers found are joined back to the records.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import boosting
from .dom import LeafText, Pages, decode, leaf_words, node_features
from .spelling import fold

#: Pages that the classifier is fitted to, at most.
TRAIN_PAGES = 500
#: A word or line seen less often has no score of its own.
LEAST_SEEN = 3

# What a site says on its own behalf within a text, and the labels of a contact block.
INVITES = re.compile(
    r"^(?:advertentie|gesponsord|sponsored|reageer nu|solliciteer nu|direct reageren|inloggen \| registreren|inloggen|registreren|aanmelden|deel(?:en| deze .*)?|printen|afdrukken)$"
    r"|\bbekeken deze pagina\b|\bdagen om te reageren via\b|\bklantenservice\b|\bnieuwsbrief\b|\bdownload onze app\b|\bonze webinars\b|\bmaak vandaag een profiel\b"
    r"|\bstel een zoekopdracht in\b|\bhelp ons de site\b|\bcookie|\b(?:log in|meld je aan) om te reageren\b|\bga je akkoord\b",
    re.I,
)
CONTACT = re.compile(r"^(?:contact\w*|meer weten\??|informatie|telefoon\w*|e-?mail\w*|bezoekadres|adres|mobiel)\b", re.I)


@dataclass
class PageModel:
    trees: boosting.Boosted
    words: dict[str, float]
    lines: dict[str, float]
    attrs: dict[str, float]


def record_marks(row) -> tuple[set[str], str]:
    """Folded short texts that mark a line by being equal to it, and the long text that marks what it contains."""
    flat = lambda s: re.sub(r"\W+", " ", fold(s)).strip()
    contact = row["contact_information"] or {}
    short = [row["title"], row["client_name"], row["location"], row["source_reference"], *(contact[k] for k in ("name", "email", "phone") if contact)]
    for k in ("requirements", "wishes", "competencies"):
        short += list(row[k] or [])
    return {flat(s) for s in short if s and len(flat(s)) > 3}, " " + flat(row["description"] or "") + " "


def weak_labels(pages: Pages, page: int, marks: tuple[set[str], str]) -> np.ndarray | None:
    """Whether each leaf of a page is main text; None if too few marks are found on it."""
    a, b = pages.first_leaf[page], pages.first_leaf[page + 1]
    short, long = marks
    texts = pages.text[a:b]
    flat = [re.sub(r"\W+", " ", fold(t)).strip() for t in texts]
    tail = lambda s: s.split(" ", 1)[1] if " " in s else s
    long_hits = [i for i, s in enumerate(flat) if len(s) > 30 and f" {s} " in long and not texts[i].endswith("...")]
    short_hits = [i for i, s in enumerate(flat) if s in short or (":" in texts[i][:40] and tail(s) in short and len(tail(s)) > 5)]
    if len(long_hits) + len(short_hits) < 4 or not long_hits:
        return None
    core = [i for i in long_hits + [i for i in short_hits if len(flat[i]) > 20]]
    # the smallest container of the marks
    def chain(i: int) -> list[int]:
        e, out = pages.of[a + i], []
        while e >= 0:
            out.append(e)
            e = pages.parent[e]
        return out[::-1]

    shared = chain(core[0])
    for i in core[1:]:
        other = chain(i)
        shared = [x for x, y in zip(shared, other) if x == y]
    box = shared[-1]
    low, high = min(core), max(core)
    if len(shared) > 2:  # inside body: the whole container belongs to the subject
        low, high = min(low, pages.start[box] - a), max(high, pages.end[box] - a - 1)
    else:  # no container of its own: from the title to the last mark and the contact lines after it
        heads = [i for i in short_hits if i <= low]
        low = min(heads, default=low)
        high = max([high, *short_hits[-1:]]) if short_hits and short_hits[-1] - high < 25 else high
        while high + 1 < len(texts) and (CONTACT.search(texts[high + 1]) or flat[high + 1] in short or "@" in texts[high + 1]):
            high += 1
    y = np.zeros(len(texts), dtype=bool)
    y[low : high + 1] = True
    for i in range(low, high + 1):
        if INVITES.search(texts[i]):
            y[i] = False
    return y


def _log_odds(inside: Counter, outside: Counter) -> dict[str, float]:
    n, m = sum(inside.values()) + 1.0, sum(outside.values()) + 1.0
    return {
        k: max(-5.0, min(5.0, math.log((inside[k] + 0.5) / n) - math.log((outside[k] + 0.5) / m)))
        for k in inside.keys() | outside.keys()
        if inside[k] + outside[k] >= LEAST_SEEN
    }


def _scores(pages: Pages, y: np.ndarray, element: np.ndarray, leaf_of_page, element_of_page, used: list[int]) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    words, lines, attrs = (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter())
    for p in used:
        for i in range(*leaf_of_page(p)):
            w = leaf_words(pages.text[i])
            words[not y[i]].update(set(w))
            lines[not y[i]][" ".join(w)] += 1
        for e in range(*element_of_page(p)):
            for k in pages.attrs[e]:
                attrs[not element[e]][k] += 1
    return _log_odds(*words), _log_odds(*lines), _log_odds(*attrs)


def fit_pages(contents: list[tuple[str, str]], marks: list[tuple[set[str], str]]) -> PageModel:
    """Fit to pages (content, format) and their records' marks. Word scores of a page come from the other half of the pages."""
    labels, kept, pages = [], [], Pages()
    for (content, kind), m in zip(contents, marks):
        one = Pages()
        one.add(content, kind)
        if (y := weak_labels(one, 0, m)) is not None:
            kept.append((content, kind))
            labels.append(y)
    for content, kind in kept:
        pages.add(content, kind)
    y = np.concatenate(labels) if labels else np.zeros(0, dtype=bool)
    run = np.concatenate([[0], np.cumsum(y)])
    start, end = np.array(pages.start, dtype=np.int64), np.array(pages.end, dtype=np.int64)
    element = (run[end] - run[start] > 0) if len(start) else np.zeros(0, dtype=bool)
    leaf_of_page = lambda p: (pages.first_leaf[p], pages.first_leaf[p + 1])
    element_of_page = lambda p: (pages.first_element[p], pages.first_element[p + 1])
    halves = [list(range(0, len(kept), 2)), list(range(1, len(kept), 2))]
    xs, ys = [], []
    for own, other in ((0, 1), (1, 0)):
        words, lines, attrs = _scores(pages, y, element, leaf_of_page, element_of_page, halves[other])
        x_element, x_leaf = node_features(pages, LeafText(words, lines), attrs)
        for p in halves[own]:
            e0, e1 = element_of_page(p)
            l0, l1 = leaf_of_page(p)
            xs += [x_element[e0:e1], x_leaf[l0:l1]]
            ys += [element[e0:e1], y[l0:l1]]
    words, lines, attrs = _scores(pages, y, element, leaf_of_page, element_of_page, range(len(kept)))
    x = np.concatenate(xs) if xs else np.zeros((0, 57), dtype=np.float32)
    return PageModel(boosting.fit(x, np.concatenate(ys).astype(float) if ys else np.zeros(0)), words, lines, attrs)


def main_lines(pages: Pages, model: PageModel, leaf_text: LeafText) -> list[list[int]]:
    """Of each page the numbers of its lines of main text, in order."""
    x_element, x_leaf = node_features(pages, leaf_text, model.attrs)
    is_main = decode(pages, model.trees.score(x_element), model.trees.score(x_leaf))
    out, line = [], pages.line
    for a, b in zip(pages.first_leaf, pages.first_leaf[1:]):
        out.append(sorted({line[i] for i in range(a, b) if is_main[i]}))
    return out


def training_sample(pages: DataFrame, records: DataFrame, most: int = TRAIN_PAGES, key: str = "id", content: str = "raw_content", kind: str = "raw_format", record_key: str = "raw_opportunity_id") -> PageModel:
    """Fit to at most ``most`` pages that have a record; their ids are taken in the order of a hash."""
    picked = [r[0] for r in records.select(record_key).where(f"{record_key} is not null and description is not null").distinct().orderBy(F.xxhash64(record_key)).limit(most).collect()]
    columns = [record_key, "title", "client_name", "location", "source_reference", "description", "requirements", "wishes", "competencies", "contact_information"]
    marks = {r[record_key]: record_marks(r.asDict(recursive=True)) for r in records.where(F.col(record_key).isin(picked)).select(*columns).collect()} if picked else {}
    # one row of each of the picked ids
    one = pages.where(F.col(key).isin(picked)).where(F.col(content).isNotNull()).groupBy(key).agg(F.min(F.struct(content, kind)).alias("p")).select(key, "p.*")
    rows = sorted((r for r in one.collect() if r[0] in marks), key=lambda r: r[0]) if picked else []
    return fit_pages([(r[1], r[2]) for r in rows], [marks[r[0]] for r in rows])


def found_lines(contents: DataFrame, model: PageModel) -> DataFrame:
    """_sha and lines (array) of contents (_sha, _content, _kind)."""
    shared = contents.sparkSession.sparkContext.broadcast(model)  # some hundred KB, bounded by TRAIN_PAGES
    schema = pa.schema([("_sha", pa.binary()), ("lines", pa.list_(pa.int32()))])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        leaf_text = LeafText(own.words, own.lines)
        for batch in batches:
            size = 256
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                pages = Pages()
                for content, kind in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    pages.add(content, kind)
                lines = main_lines(pages, own, leaf_text)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), pa.array(lines, pa.list_(pa.int32()))], schema=schema)

    return contents.select("_sha", "_content", "_kind").mapInArrow(parsed, "_sha binary, lines array<int>")


def main_content(tables: dict[str, DataFrame], model: PageModel, key: str = "id", content: str = "raw_content", kind: str = "raw_format") -> DataFrame:
    """record_table, record_id, lines: the numbers of the lines of main text of each record, by table name.

    Defined cases: null and blank contents have an empty array; rows repeated alike count once (a key with
    several contents has the lines of each); a format that is neither html nor text is told by the content; lines
    of any length are read whole; an empty table has no rows; other columns aren't read.
    """
    rows = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("record_table"), F.col(key).alias("record_id"), F.col(content).alias("_content"), F.coalesce(F.lower(F.trim(kind)), F.lit("")).alias("_kind"))
        rows = part if rows is None else rows.unionByName(part)
    sha = F.unhex(F.sha2(F.concat_ws(":", "_kind", F.coalesce("_content", F.lit(""))), 256)).alias("_sha")
    rows = rows.select("record_table", "record_id", "_content", "_kind", sha)
    found = found_lines(rows.select("_sha", "_content", "_kind").dropDuplicates(["_sha"]), model)
    ids = rows.select("record_table", "record_id", "_sha").distinct()
    return ids.join(found, "_sha").select("record_table", "record_id", "lines")


def main_text(df: DataFrame, lines: DataFrame, table: str, key: str = "id", content: str = "raw_content") -> DataFrame:
    """key, main_text: the kept lines of each record of a table, joined by line feeds. lines: a result of main_content."""
    own = lines.where(F.col("record_table") == table).select(F.col("record_id").alias(key), "lines")
    split = F.split(F.col(content), "\n", -1)
    kept = F.array_join(F.transform("lines", lambda n: F.trim(F.get(split, n - 1))), "\n")
    return df.select(key, content).distinct().join(own, key).select(key, kept.alias("main_text"))
