"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence
from ..sources.tables import read_table
from .listing import _WHITE, _collapse, records


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def normalized_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.content_hash(text.collapse(F.col("text"))).alias("hash"))


def duplicate_texts(spark, sf_dir):
    """Texts that stand in several documents; one row a text, so a group of any size is one row."""
    digest = text.content_hash(text.collapse(F.col("text"))).alias("hash")
    return _docs(spark, sf_dir).where("text is not null").groupBy(digest).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def adjacent_lines(spark, sf_dir):
    kept = text.clean_lines(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(kept, 256).alias("hash"), F.length(kept).alias("chars"))


def readable_counts(spark, sf_dir):
    n = text.readable_characters(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", n.alias("readable"), F.coalesce(n >= 50, F.lit(False)).alias("enough"))


def truncated_texts(spark, sf_dir):
    part, cut = text.truncated(F.col("text"), 1000)
    return _docs(spark, sf_dir).select("doc_id", F.length(part).alias("chars"), cut.alias("truncated"), F.sha2(part, 256).alias("hash"))


def paragraph_counts(spark, sf_dir):
    parts = text.paragraphs(F.col("text"))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(parts).alias("n"), F.get(parts, 0).alias("first"))


def controls_removed(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.without_controls(F.col("text")), 256).alias("hash"))


def phone_digits(spark, sf_dir):
    phone = F.col("contact_information.phone")
    return records(spark, sf_dir).where(phone.isNotNull()).select("id", text.digits(phone).alias("digits"), text.phone_supported(phone, F.col("description")).alias("supported"))


def contact_window(spark, sf_dir):
    marks = [F.col("contact_information.name"), F.col("contact_information.email")]
    part = text.window_around(F.col("description"), marks, 300, 1000, 1500)
    return records(spark, sf_dir).select("id", F.sha2(part, 256).alias("hash"), F.length(part).alias("chars"))


def evidence_verified(spark, sf_dir):
    """Requirements of each record that stand in its page."""
    pages = read_table(spark, sf_dir, "raw_opportunities").select(F.col("id").alias("raw_opportunity_id"), "raw_content")
    rows = records(spark, sf_dir).select("id", "raw_opportunity_id", "requirements").join(pages, "raw_opportunity_id")
    return rows.select("id", evidence.verified(F.col("requirements"), F.col("raw_content")).alias("v")).select("id", "v.total", "v.verified", F.array_join("v.missing", "|").alias("missing"))


def event_props(spark, sf_dir):
    df = read_table(spark, sf_dir, "events")
    return df.groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        normalized_hashes, duplicate_texts, adjacent_lines, readable_counts, truncated_texts, paragraph_counts, controls_removed, phone_digits, contact_window, evidence_verified, event_props
    )
}

_RECORDS = "records as (select * from structured_opportunities qualify row_number() over (partition by id order by updated_at desc) = 1)"
_fold = lambda c: f"replace(lower({c}), 'ß', 'ss')"
_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{0085}\x{2028}\x{2029}]"

SQL = {
    "normalized_hashes": f"select doc_id, sha256({_collapse('text')}) as hash from documents",
    "duplicate_texts": f"select sha256({_collapse('text')}) as hash, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1",
    "adjacent_lines": f"""with s as (select doc_id, text, list_filter(list_transform(string_split_regex(replace(text, chr(160), ' '), '{_ENDS}'), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') as a from documents),
        k as (select doc_id, case when text is not null then array_to_string(list_filter(a, lambda x, i: i = 1 or x <> a[i - 1]), chr(10)) end as t from s)
        select doc_id, sha256(t) as hash, cast(length(t) as integer) as chars from k""",
    "readable_counts": f"with r as (select doc_id, cast(length(regexp_replace(text, '{_WHITE}', '', 'g')) as integer) as readable from documents) select doc_id, readable, coalesce(readable >= 50, false) as enough from r",
    "truncated_texts": "select doc_id, cast(length(substr(text, 1, 1000)) as integer) as chars, length(text) > 1000 as truncated, sha256(substr(text, 1, 1000)) as hash from documents",
    "paragraph_counts": "with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: trim(x)), lambda x: x <> '') as a from documents where text is not null) select doc_id, cast(len(a) as integer) as n, a[1] as first from p",
    "controls_removed": r"select doc_id, sha256(regexp_replace(text, '[\x00-\x09\x0b-\x1f]', '', 'g')) as hash from documents",
    "phone_digits": f"""with {_RECORDS}, p as (select id, regexp_replace(contact_information.phone, '[^0-9]', '', 'g') as digits, description from records where contact_information.phone is not null)
        select id, digits, length(digits) >= 7 and len(list_filter(regexp_extract_all(description, '\\+?\\d[\\d\\s()./\\-]{{5,}}\\d'), lambda x: regexp_replace(x, '[^0-9]', '', 'g') = digits)) > 0 as supported from p""",
    "contact_window": f"""with {_RECORDS}, p as (select id, description, least(nullif(instr({_fold('description')}, {_fold('contact_information.name')}), 0), nullif(instr({_fold('description')}, {_fold('contact_information.email')}), 0)) as pos from records),
        w as (select id, case when pos is null then substr(description, 1, 1500) else substr(description, greatest(pos - 300, 1), pos + 1000 - greatest(pos - 300, 1)) end as t from p) select id, sha256(t) as hash, cast(length(t) as integer) as chars from w""",
    "evidence_verified": f"""with {_RECORDS}, j as (select s.id, s.requirements, {_fold(_collapse('r.raw_content'))} as page from records s join raw_opportunities r on r.id = s.raw_opportunity_id),
        m as (select *, list_filter(requirements, lambda c: not coalesce({_fold(_collapse('c'))} <> '' and contains(page, {_fold(_collapse('c'))}), false)) as lost from j)
        select id, cast(coalesce(len(requirements), 0) as integer) as total, cast(coalesce(len(requirements) - len(lost), 0) as integer) as verified, coalesce(array_to_string(lost, '|'), '') as missing from m""",
    "event_props": "select event_type, json_extract_string(props, '$.k') as k, count(*) as n from events group by 1, 2",
}
