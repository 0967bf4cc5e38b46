"""Queries over rules, sets, queues and nested or JSON records."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import arrays, text
from ..operators import constraints as cs, feed, records as rec, runs, versions
from ..sources.tables import read_table
from .listing import _collapse, records

# The columns of a listed record, and those that its details add.
LISTED = [
    "id", "source_reference", "title", "client_name", "location", "province", "work_arrangement", "start_date", "application_deadline", "hours_per_week_min", "hours_per_week_max", "rate_min", "rate_max",
    "rate_currency", "rate_period", "employment_relationship", "source_status", "application_status", "publication_date",
]
DETAILED = ["description", "end_date", "duration_months", "extension_possible", "number_of_positions", "education_level", "requirements", "wishes", "competencies", "skills", "contact_information", "extraction_confidence", "review_required"]


def _shown(columns):
    """Columns in forms that every engine writes alike."""
    for c in columns:
        if c in ("requirements", "wishes", "competencies", "skills"):
            yield F.array_join(c, "|").alias(c)
        elif c == "contact_information":
            yield from (F.col(f"{c}.{k}").alias(f"contact_{k}") for k in ("name", "email", "phone"))
        elif c in ("start_date", "end_date", "publication_date", "application_deadline"):
            yield F.date_format(c, "yyyy-MM-dd").alias(c)
        else:
            yield F.col(c)


def _shown_sql(columns):
    for c in columns:
        if c in ("requirements", "wishes", "competencies", "skills"):
            yield f"case when {c} is not null then array_to_string({c}, '|') end as {c}"
        elif c == "contact_information":
            yield from (f"{c}.{k} as contact_{k}" for k in ("name", "email", "phone"))
        elif c in ("start_date", "end_date", "publication_date", "application_deadline"):
            yield f"strftime({c}, '%Y-%m-%d') as {c}"
        else:
            yield c


def list_view(spark, sf_dir):
    return records(spark, sf_dir).select(*_shown(LISTED))


def detail_view(spark, sf_dir):
    return records(spark, sf_dir).select(*_shown(LISTED + DETAILED))


def feed_equal_filters(spark, sf_dir):
    rows = feed.filtered(records(spark, sf_dir), {"work_arrangement": "hybrid", "application_status": "open", "search": None})
    return rows.select("id", "work_arrangement", "application_status")


def numeric_references(spark, sf_dir):
    return read_table(spark, sf_dir, "raw_opportunities").select("id", text.is_number(F.col("source_reference")).alias("numeric"))


def partial_ranges(spark, sf_dir):
    part = lambda c, f: f(F.col(c))
    ok = arrays.range_valid(part("end_date", F.year), part("end_date", F.month), part("start_date", F.year), part("start_date", F.month))
    return records(spark, sf_dir).select("id", ok.alias("ends_first"))


def parts_in_page(spark, sf_dir):
    """Whether a record's page holds its title and its client."""
    pages = read_table(spark, sf_dir, "raw_opportunities").select(F.col("id").alias("raw_opportunity_id"), "raw_content")
    both = records(spark, sf_dir).join(pages, "raw_opportunity_id")
    return both.select("id", text.contains_all(F.col("raw_content"), [F.col("title"), F.col("client_name")]).alias("holds"))


def typed_configurations(spark, sf_dir):
    """A source's configuration read by a schema that lacks one field and asks for another."""
    schema = T.StructType([T.StructField("request_delay_seconds", T.DoubleType()), T.StructField("mode", T.StringType())])
    typed = rec.typed_json(read_table(spark, sf_dir, "sources"), "configuration", schema, required=["mode"])
    flat = rec.flattened(typed, "record", ["code", "issues"], {"mode": (["full"], "other")})
    return flat.select("code", F.array_join("issues", ",").alias("issues"), F.col("request_delay_seconds").alias("delay"), "mode")


def normalized_kinds(spark, sf_dir):
    """Hashes of normalised contents: documents as text, the properties of events as JSON."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), F.col("text").alias("content"))
    events = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("json").alias("kind"), F.col("props").alias("content"))
    return docs.union(events).select("id", "kind", text.content_hash(rec.normalized_content(F.col("content"), F.col("kind"))).alias("hash"))


def changed_since_first(spark, sf_dir):
    """Raw rows whose content isn't that of their first version any more."""
    first = versions.latest(read_table(spark, sf_dir, "raw_opportunity_versions"), ["raw_opportunity_id"], [F.col("version_number"), F.col("id")])
    first = first.select(F.col("raw_opportunity_id").alias("id"), F.col("content_hash").alias("first_hash"))
    raw = read_table(spark, sf_dir, "raw_opportunities").select("id", "content_hash")
    return raw.join(first, "id").where(~F.col("content_hash").eqNullSafe(F.col("first_hash"))).select("id")


def dangling_exports(spark, sf_dir):
    """Rows of each export whose page is gone."""
    exports = read_table(spark, sf_dir, "raw_opportunity_snapshots").select("snapshot_no", "raw_opportunity_id")
    gone = cs.dangling(exports, "raw_opportunity_id", read_table(spark, sf_dir, "raw_opportunities"), "id")
    return gone.groupBy("snapshot_no").agg(F.count("*").alias("n"))


def exports_set_null(spark, sf_dir):
    """Rows of each export with and without a page once references to missing ones are null."""
    exports = read_table(spark, sf_dir, "raw_opportunity_snapshots").select("snapshot_no", "raw_opportunity_id")
    kept = cs.set_null(exports, "raw_opportunity_id", read_table(spark, sf_dir, "raw_opportunities"), "id")
    return kept.groupBy("snapshot_no").agg(F.count("raw_opportunity_id").alias("kept"), F.count_if(F.col("raw_opportunity_id").isNull()).alias("unset"))


def undeletable_cvs(spark, sf_dir):
    return cs.restricted(read_table(spark, sf_dir, "user_cvs").select("id", "user_id"), "id", read_table(spark, sf_dir, "evidence_snippets"), "user_cv_id")


def distinct_found(spark, sf_dir):
    """How many different references and clients each source has."""
    return read_table(spark, sf_dir, "structured_opportunities").groupBy("source_id").agg(F.count_distinct("source_reference").alias("refs"), F.count_distinct("client_name").alias("clients"))


def equal_sets(spark, sf_dir):
    doubled = F.concat("skills", F.reverse("skills"))
    return records(spark, sf_dir).select("id", arrays.same_set(F.col("skills"), doubled).alias("with_itself"), arrays.same_set(F.col("skills"), F.col("competencies")).alias("with_competencies"))


def classification_queue(spark, sf_dir):
    """The newest pages whose present content no record was extracted from: page and hash are the two keys."""
    raw = read_table(spark, sf_dir, "raw_opportunities").where("source_status = 'active'").select("id", "content_hash", "updated_at")
    done = read_table(spark, sf_dir, "structured_opportunities").select(F.col("raw_opportunity_id").alias("id"), F.col("extracted_from_hash").alias("content_hash"))
    return runs.work_queue(raw, done, ["id", "content_hash"], [F.col("updated_at").desc_nulls_last(), F.col("id")], 20).select("id", "content_hash")


def record_texts(spark, sf_dir):
    """How many texts a record holds in all of its nested columns, and their hash in order of their paths."""
    found = rec.leaves(records(spark, sf_dir), "id", ["contact_information", "requirements", "wishes", "title"])
    return found.select("id", "path", "value")


def url_queries(spark, sf_dir):
    u = F.col("base_url")
    built = F.concat(u, F.lit("/search?ref="), F.url_encode("name"), F.lit("&page=2"))
    return read_table(spark, sf_dir, "sources").select("code", F.try_parse_url(built, F.lit("QUERY"), F.lit("page")).alias("page"), F.try_parse_url(built, F.lit("PATH")).alias("path"))


def backfilled_runs(spark, sf_dir):
    runs_ = read_table(spark, sf_dir, "fetch_runs").select("id", "status", "error_message")
    errors = runs_.where("status = 'failed'").select("id", F.repeat(F.coalesce("error_message", F.lit("unknown ")), 500).alias("error_message"))
    return versions.backfilled(versions.failed(runs_, errors, "id", "error_message"), {"error_message": "none"}).select("id", "status", F.length("error_message").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        list_view, detail_view, feed_equal_filters, numeric_references, partial_ranges, parts_in_page, typed_configurations, normalized_kinds, changed_since_first, dangling_exports, exports_set_null, undeletable_cvs,
        distinct_found, equal_sets, classification_queue, record_texts, url_queries, backfilled_runs,
    )
}

_RECORDS = "records as (select * from structured_opportunities qualify row_number() over (partition by id order by updated_at desc) = 1)"
_LEAVES = " union all ".join(
    [f"select id, 'contact_information.{k}' as path, contact_information.{k} as value from records" for k in ("name", "email", "phone")]
    + [f"select id, '{c}[' || (i - 1) || ']', v from (select id, unnest({c}) as v, generate_subscripts({c}, 1) as i from records)" for c in ("requirements", "wishes")]
    + ["select id, 'title', title from records"]
)
_MONTHS = "year(start_date) as sy, month(start_date) as sm, year(end_date) as ey, month(end_date) as em"

SQL = {
    "list_view": f"with {_RECORDS} select {', '.join(_shown_sql(LISTED))} from records",
    "detail_view": f"with {_RECORDS} select {', '.join(_shown_sql(LISTED + DETAILED))} from records",
    "feed_equal_filters": f"with {_RECORDS} select id, work_arrangement, application_status from records where work_arrangement = 'hybrid' and application_status = 'open'",
    "numeric_references": "select id, regexp_full_match(trim(source_reference), '[0-9]+') as numeric from raw_opportunities",
    "partial_ranges": f"with {_RECORDS}, p as (select id, {_MONTHS} from records) select id, coalesce(ey < sy or (ey = sy and coalesce(em <= sm, true)), ey is null or sy is null) as ends_first from p",
    "parts_in_page": f"with {_RECORDS} select s.id, contains(r.raw_content, s.title) and contains(r.raw_content, s.client_name) as holds from records s join raw_opportunities r on r.id = s.raw_opportunity_id",
    "typed_configurations": """select code, case when configuration is null then 'not_json' else 'missing:mode' end as issues, cast(json_extract_string(configuration, '$.request_delay_seconds') as double) as delay, 'other' as mode from sources""",
    "normalized_kinds": f"select doc_id as id, 'text' as kind, sha256({_collapse('text')}) as hash from documents union all select event_id, 'json', sha256(replace(props, ' ', '')) from events",
    "changed_since_first": "with f as (select * from raw_opportunity_versions qualify row_number() over (partition by raw_opportunity_id order by version_number, id) = 1) select r.id from raw_opportunities r join f on f.raw_opportunity_id = r.id where r.content_hash is distinct from f.content_hash",
    "dangling_exports": "select snapshot_no, count(*) as n from raw_opportunity_snapshots s where raw_opportunity_id is not null and not exists (select 1 from raw_opportunities r where r.id = s.raw_opportunity_id) group by 1",
    "exports_set_null": "select snapshot_no, count(r.id) as kept, count(*) - count(r.id) as unset from raw_opportunity_snapshots s left join raw_opportunities r on r.id = s.raw_opportunity_id group by 1",
    "undeletable_cvs": "select id, user_id from user_cvs where id in (select user_cv_id from evidence_snippets where user_cv_id is not null)",
    "distinct_found": "select source_id, count(distinct source_reference) as refs, count(distinct client_name) as clients from structured_opportunities group by 1",
    "equal_sets": f"""with {_RECORDS} select id, list_sort(list_distinct(skills)) is not distinct from list_sort(list_distinct(list_concat(skills, list_reverse(skills)))) as with_itself,
        list_sort(list_distinct(skills)) is not distinct from list_sort(list_distinct(competencies)) as with_competencies from records""",
    "classification_queue": """select id, content_hash from raw_opportunities r where source_status = 'active' and not exists
        (select 1 from structured_opportunities s where s.raw_opportunity_id = r.id and s.extracted_from_hash = r.content_hash) order by updated_at desc nulls last, id limit 20""",
    "record_texts": f"with {_RECORDS}, l as ({_LEAVES}) select id, path, value from l where value is not null",
    "url_queries": "select code, '2' as page, regexp_extract(base_url || '/search', '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from sources",
    "backfilled_runs": "select id, status, cast(case when status = 'failed' then least(4000, length(coalesce(error_message, 'unknown ')) * 500) else length(coalesce(error_message, 'none')) end as integer) as chars from fetch_runs",
}
