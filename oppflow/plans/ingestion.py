"""Queries over runs, raw pages and their versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, text
from ..operators import constraints as cs, feed, records, runs, versions
from ..sources.documents import safe_file_name, storage_path
from ..sources.tables import read_table


def stored_versions(spark, sf_dir):
    """raw_opportunity_versions, rows delivered twice once; partitioned by page, which every later step keeps."""
    df = read_table(spark, sf_dir, "raw_opportunity_versions").select("id", "raw_opportunity_id", "fetch_run_id", "version_number", "content_hash", "normalized_content_hash", "created_at")
    return df.repartition("raw_opportunity_id").dropDuplicates(["raw_opportunity_id", "id"])


def _told(spark, sf_dir):
    print_ = F.coalesce("normalized_content_hash", "content_hash")
    return versions.observed_actions(stored_versions(spark, sf_dir), ["raw_opportunity_id"], [F.col("version_number"), F.col("id")], print_)


def cdc_actions(spark, sf_dir):
    return _told(spark, sf_dir).select("id", "raw_opportunity_id", "action", "version_no")


def content_hashes(spark, sf_dir):
    df = read_table(spark, sf_dir, "raw_opportunities")
    return df.select("id", text.content_hash(F.col("raw_content")).alias("sha"), text.content_hash(F.col("raw_content")).eqNullSafe(F.col("content_hash")).alias("as_stored"))


def changed_since_stored(spark, sf_dir):
    """Raw rows whose hash isn't that of their last version."""
    last = versions.latest(stored_versions(spark, sf_dir), ["raw_opportunity_id"], [F.col("version_number").desc(), F.col("id")])
    last = last.select(F.col("raw_opportunity_id").alias("id"), F.col("content_hash").alias("stored"), "version_number")
    raw = read_table(spark, sf_dir, "raw_opportunities").select("id", "content_hash")
    return raw.join(last, "id").where(~F.col("content_hash").eqNullSafe(F.col("stored"))).select("id", "version_number")


def _last_two(df):
    """The numbers of the last export and the one before it (None if there are fewer)."""
    found = [r[0] for r in df.select("snapshot_no").where("snapshot_no is not null").distinct().orderBy(F.desc("snapshot_no")).limit(2).collect()]
    return [*found, None, None][1], [*found, None][0]


def merged_current(spark, sf_dir):
    """The last export merged into the one before it: the next current table."""
    df = read_table(spark, sf_dir, "raw_opportunity_snapshots")
    before, last = _last_two(df)
    columns = ["source_id", "source_reference", "title_hint", "content_hash", "source_status", "processing_status"]
    key = lambda d: d.withColumn("source_reference", F.upper(F.trim("source_reference")))
    order = ["delivered_at", "content_hash", "source_status", "title_hint", "processing_status"]
    part = lambda n: versions.last_observed(key(df.where(F.col("snapshot_no") == F.lit(n)).select(*columns, "delivered_at")), ["source_id", "source_reference"], order)
    merged = versions.merge_current(part(before).select(*columns), part(last), ["source_id", "source_reference"], "content_hash", "delivered_at", ["title_hint"], {"processing_status": "pending"})
    return merged.select(*columns, "action")


def upserted_cvs(spark, sf_dir):
    """Unprocessed CVs set aside and brought in again as ready."""
    df = read_table(spark, sf_dir, "user_cvs").select("id", "user_id", "processing_status")
    return versions.upsert(df, df.where("processing_status <> 'ready'").withColumn("processing_status", F.lit("ready")), ["id"])


def sole_active_cv(spark, sf_dir):
    df = read_table(spark, sf_dir, "user_cvs")
    return versions.sole_active(df, "user_id", [F.col("is_active").desc_nulls_last(), F.col("uploaded_at").desc_nulls_last(), F.col("id")]).select("id", "user_id", "is_active")


def run_summary(spark, sf_dir):
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    done = F.coalesce(F.sum(F.coalesce("items_new", F.lit(0)) + F.coalesce("items_changed", F.lit(0)) + F.coalesce("items_unchanged", F.lit(0))), F.lit(0))
    df = read_table(spark, sf_dir, "fetch_runs").groupBy("source_id").agg(
        F.count("*").alias("runs"), zero("items_new").alias("new"), zero("items_changed").alias("changed"), zero("items_unchanged").alias("unchanged"), zero("items_failed").alias("failed"), done.alias("done")
    )
    return df.withColumn("status", runs.rolled_up_status(F.col("done"), F.col("failed")))


def action_summary(spark, sf_dir):
    return runs.action_counts(_told(spark, sf_dir).where("fetch_run_id is not null"), ["fetch_run_id"])


def batch_summary(spark, sf_dir):
    df = runs.numbered_batches(_told(spark, sf_dir).withColumn("day", F.to_date("created_at").cast("string")), ["day"], [F.col("created_at"), F.col("id")], 25)
    return runs.action_counts(df, ["day", "batch_no"])


def _ordered_runs(spark, sf_dir):
    df = read_table(spark, sf_dir, "fetch_runs")
    return runs.with_previous(df, ["source_id"], [F.col("started_at"), F.col("id")], "items_discovered", "previous", F.col("status") == "succeeded")


def closure_guard(spark, sf_dir):
    allowed, bound = runs.closure_guard(F.col("items_discovered"), F.col("previous"))
    return _ordered_runs(spark, sf_dir).select("id", "items_discovered", "previous", allowed.alias("allowed"), bound.alias("bound"))


def latest_run(spark, sf_dir):
    df = read_table(spark, sf_dir, "fetch_runs")
    return versions.latest(df, ["source_id"], [F.col("started_at").desc(), F.col("id")], qualifying=F.col("status") == "succeeded").select("source_id", "id", "items_discovered")


def latest_of_newest(spark, sf_dir):
    df = read_table(spark, sf_dir, "fetch_runs")
    return versions.latest(df, ["source_id"], [F.col("started_at").desc(), F.col("id")], among=20, qualifying=F.col("error_message").isNotNull()).select("source_id", "id", "error_message")


def source_health(spark, sf_dir):
    sources = read_table(spark, sf_dir, "sources").select("id", "name")
    last = versions.latest(read_table(spark, sf_dir, "fetch_runs"), ["source_id"], [F.col("started_at").desc(), F.col("id")])
    last = last.select(F.col("source_id").alias("id"), F.col("status").alias("last_status"), F.col("started_at").cast("string").alias("last_started"))
    return sources.join(last, "id", "left")


def source_errors(spark, sf_dir):
    return runs.first_errors(read_table(spark, sf_dir, "fetch_runs"), ["source_id"], "error_message", ["started_at", "id"])


def source_registry(spark, sf_dir):
    return read_table(spark, sf_dir, "sources").where("is_active").orderBy("name").select("id", "code", "name", F.get_json_object("configuration", "$.request_delay_seconds").cast("double").alias("delay"))


def configuration_merge(spark, sf_dir):
    merged = text.merged_json(F.col("configuration"), F.lit('{"mode": "full"}'))
    return read_table(spark, sf_dir, "sources").select("code", F.get_json_object(merged, "$.mode").alias("mode"), F.get_json_object(merged, "$.request_delay_seconds").alias("delay"))


def purged_rows(spark, sf_dir):
    """Exported keys without a raw row any more."""
    seen = read_table(spark, sf_dir, "raw_opportunities").select(F.col("id").alias("raw_opportunity_id"))
    exported = read_table(spark, sf_dir, "raw_opportunity_snapshots").select("raw_opportunity_id").distinct()
    return runs.missing_rows(exported, seen, ["raw_opportunity_id"])


def extraction_queue(spark, sf_dir):
    raw = read_table(spark, sf_dir, "raw_opportunities").where("source_status = 'active'").select("id", "source_id", "source_reference", "updated_at")
    done = read_table(spark, sf_dir, "structured_opportunities").select(F.col("raw_opportunity_id").alias("id"))
    return runs.missing_rows(raw, done, ["id"]).select("id", "source_id", "source_reference").orderBy("id")


def idempotency_keys(spark, sf_dir):
    df = read_table(spark, sf_dir, "raw_opportunities")
    return df.select("id", text.key_of(F.col("id"), F.coalesce("normalized_content_hash", "content_hash"), F.lit("v1"), F.col("raw_format"), F.col("title_hint")).alias("key"))


def references_found(spark, sf_dir):
    found = text.find_references(F.col("raw_content"), r"/o/([0-9]+)")
    return read_table(spark, sf_dir, "raw_opportunities").select("id", F.array_join(found, ",").alias("refs"))


def url_parts(spark, sf_dir):
    u = F.col("source_url")
    return read_table(spark, sf_dir, "raw_opportunities").select("id", F.try_parse_url(u, F.lit("HOST")).alias("host"), F.try_parse_url(u, F.lit("PATH")).alias("path"))


def closed_notices(spark, sf_dir):
    closed = text.contains_any(F.col("raw_content"), ["is gesloten", "niet meer mogelijk", "niet meer beschikbaar", "verlopen opdracht"])
    return read_table(spark, sf_dir, "raw_opportunities").select("id", F.when(closed, "closed").otherwise("active").alias("noticed"))


def dangling_references(spark, sf_dir):
    t = lambda n: read_table(spark, sf_dir, n)
    parts = [
        ("run_of_raw", t("raw_opportunities"), "latest_fetch_run_id", t("fetch_runs")), ("raw_of_version", t("raw_opportunity_versions"), "raw_opportunity_id", t("raw_opportunities")),
        ("cv_of_snippet", t("evidence_snippets"), "user_cv_id", t("user_cvs")), ("raw_of_record", t("structured_opportunities"), "raw_opportunity_id", t("raw_opportunities")),
        ("source_of_run", t("fetch_runs"), "source_id", t("sources")),
    ]
    out = None
    for name, child, column, parent in parts:
        one = cs.dangling(child.select(column), column, parent, "id").select(F.lit(name).alias("reference"), F.col(column).alias("missing_id"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("reference", "missing_id").agg(F.count("*").alias("rows"))


def page_texts(spark, sf_dir):
    """Visible text, prepared text and title of every HTML page, parsed once a row."""
    pages = read_table(spark, sf_dir, "raw_opportunities").where("raw_format = 'html'").select("id", html.parsed_page(F.col("raw_content")).alias("p"))
    return pages.select("id", text.content_hash(F.col("p.visible")).alias("visible_hash"), "p.prepared_chars", "p.truncated", "p.title")


def file_names(spark, sf_dir):
    name = safe_file_name(F.col("original_filename"))
    return read_table(spark, sf_dir, "user_cvs").select("id", text.percent_encoded(name).alias("encoded"), storage_path(F.col("user_id"), F.col("id"), F.col("mime_type")).alias("path"))


def owned_cvs(spark, sf_dir):
    df = read_table(spark, sf_dir, "user_cvs")
    owner = df.agg(F.min("user_id").alias("user_id"))
    return df.join(owner, "user_id", "left_semi").select("id", "user_id", "is_active")


def snippets_of_cvs(spark, sf_dir):
    cvs = read_table(spark, sf_dir, "user_cvs").select(F.col("id").alias("cv_id"))
    parts = read_table(spark, sf_dir, "evidence_snippets").dropDuplicates(["snippet_id"])
    out = feed.nested(cvs, parts, "cv_id", "user_cv_id", ["snippet_no", "snippet_id"], "snippets")
    return out.select("cv_id", F.size("snippets").alias("n"), F.array_join(F.transform("snippets", lambda s: s["snippet_id"]), ",").alias("ids"))


def cvs_with_evidence(spark, sf_dir):
    return cs.cascaded(read_table(spark, sf_dir, "user_cvs").select("id", "user_id"), "id", read_table(spark, sf_dir, "evidence_snippets"), "user_cv_id")


QUERIES = {
    f.__name__: f
    for f in (
        cdc_actions, content_hashes, changed_since_stored, merged_current, upserted_cvs, sole_active_cv, run_summary, action_summary, batch_summary, closure_guard, latest_run, latest_of_newest, source_health,
        source_errors, source_registry, configuration_merge, purged_rows, extraction_queue, idempotency_keys, references_found, url_parts, closed_notices, dangling_references, page_texts, file_names, owned_cvs,
        snippets_of_cvs, cvs_with_evidence,
    )
}

_V = "v as (select * from raw_opportunity_versions qualify row_number() over (partition by id) = 1)"
_TOLD = f"""{_V}, l as (select *, coalesce(normalized_content_hash, content_hash) as f, lag(coalesce(normalized_content_hash, content_hash)) over w as before, row_number() over w as n
    from v window w as (partition by raw_opportunity_id order by version_number, id)),
    told as (select *, case when n = 1 then 'created' when f is not distinct from before then 'unchanged' else 'changed' end as action from l)"""
_COUNTS = ", ".join(f"count(*) filter (where action = '{k}') as {k}" for k in ("created", "changed", "unchanged", "failed"))
_LAST = lambda n: f"""(select source_id, upper(trim(source_reference)) as source_reference, title_hint, content_hash, source_status, processing_status from raw_opportunity_snapshots
    where snapshot_no = ({n}) qualify row_number() over (partition by source_id, upper(trim(source_reference)) order by delivered_at desc, content_hash desc nulls last, source_status desc nulls last, title_hint desc nulls last, processing_status desc nulls last) = 1)"""  # noqa: E731

_NEWEST = "select max(snapshot_no) from raw_opportunity_snapshots"
_BEFORE = f"select max(snapshot_no) from raw_opportunity_snapshots where snapshot_no < ({_NEWEST})"

SQL = {
    "cdc_actions": f"with {_TOLD} select id, raw_opportunity_id, action, cast(sum(case when action <> 'unchanged' then 1 else 0 end) over (partition by raw_opportunity_id order by version_number, id) as integer) as version_no from told",
    "content_hashes": "select id, sha256(raw_content) as sha, sha256(raw_content) is not distinct from content_hash as as_stored from raw_opportunities",
    "changed_since_stored": f"with {_V}, last as (select * from v qualify row_number() over (partition by raw_opportunity_id order by version_number desc, id) = 1) select r.id, l.version_number from raw_opportunities r join last l on l.raw_opportunity_id = r.id where r.content_hash is distinct from l.content_hash",
    "merged_current": f"""with o as {_LAST(_BEFORE)}, i as {_LAST(_NEWEST)} select coalesce(o.source_id, i.source_id) as source_id, coalesce(o.source_reference, i.source_reference) as source_reference,
        case when i.source_id is null then o.title_hint else coalesce(i.title_hint, o.title_hint) end as title_hint, case when i.source_id is null then o.content_hash else i.content_hash end as content_hash,
        case when i.source_id is null then o.source_status else i.source_status end as source_status,
        case when i.source_id is null then o.processing_status when o.source_id is null or o.content_hash is distinct from i.content_hash then 'pending' else o.processing_status end as processing_status,
        case when i.source_id is null then 'kept' when o.source_id is null then 'created' when o.content_hash is not distinct from i.content_hash then 'unchanged' else 'changed' end as action
        from o full join i on o.source_id is not distinct from i.source_id and o.source_reference is not distinct from i.source_reference""",
    "upserted_cvs": "select id, user_id, case when processing_status <> 'ready' then 'ready' else processing_status end as processing_status from user_cvs",
    "sole_active_cv": "select id, user_id, row_number() over (partition by user_id order by is_active desc nulls last, uploaded_at desc nulls last, id) = 1 as is_active from user_cvs",
    "run_summary": """with s as (select source_id, count(*) as runs, coalesce(sum(items_new), 0) as new, coalesce(sum(items_changed), 0) as changed, coalesce(sum(items_unchanged), 0) as unchanged, coalesce(sum(items_failed), 0) as failed,
        coalesce(sum(coalesce(items_new, 0) + coalesce(items_changed, 0) + coalesce(items_unchanged, 0)), 0) as done from fetch_runs group by source_id)
        select source_id, runs, cast(new as bigint) as new, cast(changed as bigint) as changed, cast(unchanged as bigint) as unchanged, cast(failed as bigint) as failed, cast(done as bigint) as done,
        case when failed = 0 then 'succeeded' when done > 0 then 'partial' else 'failed' end as status from s""",
    "action_summary": f"with {_TOLD} select fetch_run_id, {_COUNTS} from told where fetch_run_id is not null group by fetch_run_id",
    "batch_summary": f"with {_TOLD}, b as (select *, strftime(created_at, '%Y-%m-%d') as day, cast(ceil(row_number() over (partition by strftime(created_at, '%Y-%m-%d') order by created_at, id) / 25.0) as integer) as batch_no from told) select day, batch_no, {_COUNTS} from b group by day, batch_no",
    "closure_guard": """with p as (select *, last_value(case when status = 'succeeded' then {'v': items_discovered} end ignore nulls) over (partition by source_id order by started_at, id rows between unbounded preceding and 1 preceding) as held from fetch_runs),
        q as (select id, items_discovered, held.v as previous from p), b as (select *, case when previous >= 1 then greatest(50, cast(ceil(previous * 0.70) as bigint)) end as bound from q)
        select id, items_discovered, previous, coalesce(items_discovered >= bound, false) as allowed, bound from b""",
    "latest_run": "select source_id, id, items_discovered from fetch_runs where status = 'succeeded' qualify row_number() over (partition by source_id order by started_at desc, id) = 1",
    "latest_of_newest": "with n as (select *, row_number() over (partition by source_id order by started_at desc, id) as k from fetch_runs) select source_id, id, error_message from n where k <= 20 and error_message is not null qualify row_number() over (partition by source_id order by k) = 1",
    "source_health": "with l as (select * from fetch_runs qualify row_number() over (partition by source_id order by started_at desc, id) = 1) select s.id, s.name, l.status as last_status, strftime(l.started_at, '%Y-%m-%d %H:%M:%S') as last_started from sources s left join l on l.source_id = s.id",
    "source_errors": "with n as (select *, row_number() over (partition by source_id order by started_at, id, error_message) as k from fetch_runs where error_message is not null) select source_id, string_agg(error_message, '; ' order by k) as errors from n where k <= 5 group by source_id",
    "source_registry": "select id, code, name, cast(json_extract_string(configuration, '$.request_delay_seconds') as double) as delay from sources where is_active order by name",
    "configuration_merge": "select code, 'full' as mode, json_extract_string(configuration, '$.request_delay_seconds') as delay from sources",
    "purged_rows": "select distinct raw_opportunity_id from raw_opportunity_snapshots s where not exists (select 1 from raw_opportunities r where r.id = s.raw_opportunity_id)",
    "extraction_queue": "select id, source_id, source_reference from raw_opportunities r where source_status = 'active' and not exists (select 1 from structured_opportunities s where s.raw_opportunity_id = r.id)",
    "idempotency_keys": """with p as (select id, trim(id) a, trim(coalesce(normalized_content_hash, content_hash)) b, trim(raw_format) c, trim(title_hint) d from raw_opportunities)
        select id, case when a <> '' and b <> '' and c <> '' and d <> '' then sha256(concat_ws('|', a, b, 'v1', c, d)) end as key from p""",
    "references_found": """with f as (select id, raw_content, regexp_extract_all(replace(raw_content, '\\/', '/'), '/o/([0-9]+)', 1) as a from raw_opportunities)
        select id, case when raw_content is not null then array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') end as refs from f""",
    "url_parts": "select id, nullif(regexp_extract(source_url, '^[a-z]+://([^/:?#]+)', 1), '') as host, case when source_url is not null then regexp_extract(source_url, '^[a-z]+://[^/?#]+([^?#]*)', 1) end as path from raw_opportunities",
    "closed_notices": "select id, case when contains(replace(lower(raw_content), 'ß', 'ss'), 'is gesloten') or contains(replace(lower(raw_content), 'ß', 'ss'), 'niet meer mogelijk') or contains(replace(lower(raw_content), 'ß', 'ss'), 'niet meer beschikbaar') or contains(replace(lower(raw_content), 'ß', 'ss'), 'verlopen opdracht') then 'closed' else 'active' end as noticed from raw_opportunities",
    "dangling_references": """with d as (select 'run_of_raw' as reference, latest_fetch_run_id as missing_id from raw_opportunities where latest_fetch_run_id not in (select id from fetch_runs)
        union all select 'raw_of_version', raw_opportunity_id from raw_opportunity_versions where raw_opportunity_id not in (select id from raw_opportunities)
        union all select 'cv_of_snippet', user_cv_id from evidence_snippets where user_cv_id not in (select id from user_cvs)
        union all select 'raw_of_record', raw_opportunity_id from structured_opportunities where raw_opportunity_id not in (select id from raw_opportunities)
        union all select 'source_of_run', source_id from fetch_runs where source_id not in (select id from sources))
        select reference, missing_id, count(*) as rows from d group by 1, 2""",
    "file_names": """with n as (select *, nullif(substr(trim(regexp_replace(regexp_replace(original_filename, '^.*[/\\\\]', ''), '[\\x00-\\x1f\\x7f]', '', 'g')), 1, 255), '') as name from user_cvs)
        select id, url_encode(name) as encoded, user_id || '/' || id || case mime_type when 'application/pdf' then '.pdf' when 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' then '.docx' else '' end as path from n""",
    "owned_cvs": "select id, user_id, is_active from user_cvs where user_id = (select min(user_id) from user_cvs)",
    "snippets_of_cvs": """with s as (select * from evidence_snippets qualify row_number() over (partition by snippet_id) = 1)
        select c.id as cv_id, cast(count(s.snippet_id) as integer) as n, coalesce(string_agg(s.snippet_id, ',' order by s.snippet_no nulls first, s.snippet_id), '') as ids from user_cvs c left join s on s.user_cv_id = c.id group by c.id""",
    "cvs_with_evidence": "select id, user_id from user_cvs c where exists (select 1 from evidence_snippets s where s.user_cv_id = c.id)",
}


def reservations(spark, sf_dir):
    """Raw pages against the records extracted from them: the ledger's key is the page's hash."""
    work = read_table(spark, sf_dir, "raw_opportunities").select("id", F.coalesce("normalized_content_hash", "content_hash").alias("input_hash"))
    done = read_table(spark, sf_dir, "structured_opportunities").select(
        F.col("extracted_from_hash").alias("input_hash"), F.when(F.col("review_required"), "review_required").otherwise("succeeded").alias("status"), F.col("id").alias("result_id")
    )
    return records.reserved(work, done, "input_hash").select("id", "reservation")


def closed_missing(spark, sf_dir):
    """Rows of the export before the last that the last one lacks, closed in sources whose count allows it."""
    df = read_table(spark, sf_dir, "raw_opportunity_snapshots").withColumn("source_reference", F.upper(F.trim("source_reference"))).withColumn("source_status", F.lower(F.trim("source_status")))
    kept = df.select("snapshot_no", "source_id", "source_reference", "source_status", "delivered_at")
    part = lambda n: versions.last_observed(kept.where(F.col("snapshot_no") == F.lit(n)), ["source_id", "source_reference"], ["delivered_at", "source_status"]).select("source_id", "source_reference", "source_status")
    old, new = map(part, _last_two(df))
    size = lambda d, c: d.groupBy("source_id").agg(F.count("*").alias(c))
    counts = size(old, "previous").join(size(new, "found"), "source_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return records.closed_missing(old, new, counts, ["source_id", "source_reference"], "source_id", least=5, ratio="0.70")


QUERIES |= {"reservations": reservations, "closed_missing": closed_missing}
_PART = lambda n: f"""(select source_id, upper(trim(source_reference)) as source_reference, lower(trim(source_status)) as source_status from raw_opportunity_snapshots where snapshot_no = ({n})
    qualify row_number() over (partition by source_id, upper(trim(source_reference)) order by delivered_at desc, lower(trim(source_status)) desc nulls last) = 1)"""  # noqa: E731
SQL |= {
    "reservations": """with l as (select extracted_from_hash as h, bool_or(id is not null) as done from structured_opportunities where extracted_from_hash is not null group by 1)
        select r.id, case when l.done then 'skip' when l.done is not null then 'reset' else 'new' end as reservation from raw_opportunities r left join l on l.h = coalesce(r.normalized_content_hash, r.content_hash)""",
    "closed_missing": f"""with o as {_PART(_BEFORE)}, n as {_PART(_NEWEST)}, c as (select source_id, count(*) as previous, (select count(*) from n where n.source_id = o.source_id) as found from o group by source_id),
        free as (select source_id from c where found >= greatest(5, ceil(previous * 0.70)))
        select o.source_id, o.source_reference, case when o.source_status = 'active' and n.source_id is null and o.source_id in (select source_id from free) then 'closed' else o.source_status end as source_status
        from o left join n on n.source_id = o.source_id and n.source_reference = o.source_reference""",
}
