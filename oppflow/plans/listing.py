"""Queries over records, scores and the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import constraints as cs, feed, versions
from ..sources.tables import read_table

ORDER = ["process", "data", "ict", "finance"]
#: The tables hold no scores; these stand for them: two factors for each discipline.
FACTORS = {"process": (7, 3), "data": (11, 5), "ict": (13, 7), "finance": (17, 2)}
THRESHOLD, MOST = 60, 3


def records(spark, sf_dir):
    """structured_opportunities, rows delivered twice once."""
    return versions.latest(read_table(spark, sf_dir, "structured_opportunities"), ["id"], [F.col("updated_at").desc()])


def wide_scores(df, as_columns=False):
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    columns = [F.pmod(size("title") * a + size("description") * b, F.lit(101)).cast("int").alias(k) for k, (a, b) in FACTORS.items()]
    return columns if as_columns else df.select("id", *columns)


_RECORDS = "records as (select * from structured_opportunities qualify row_number() over (partition by id order by updated_at desc) = 1)"
_WIDE = "wide as (select id, " + ", ".join(
    f"cast((length(coalesce(title, '')) * {a} + length(coalesce(description, '')) * {b}) % 101 as integer) as {k}" for k, (a, b) in FACTORS.items()
) + " from records)"
_LONG = "long as (" + " union all ".join(f"select id, '{k}' as discipline, {k} as score from wide" for k in ORDER) + ")"
_PLACE = "case discipline " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(ORDER)) + " end"


def unpivot_scores(spark, sf_dir):
    return feed.long_scores(wide_scores(records(spark, sf_dir)), ["id"], {k: k for k in ORDER})


def _matches(spark, sf_dir):
    """Active records unpivoted to a row for each discipline whose score reaches the threshold: one scan, one shuffle."""
    rows = records(spark, sf_dir).where("source_status = 'active'")
    kept = ["id", "title", "client_name", "application_deadline"]
    scored = rows.select(*kept, *wide_scores(rows, as_columns=True))
    return feed.long_scores(scored, kept, {k: k for k in ORDER}).where(F.col("score") >= THRESHOLD)


def _joined_matches(spark, sf_dir):
    """The same from three tables."""
    rows = records(spark, sf_dir)
    classified = rows.select("id", F.lit(THRESHOLD).alias("relevance_threshold"))
    listed = rows.select("id", "title", "client_name", "province", "work_arrangement", "application_deadline", "source_status")
    return feed.feed_matches(listed, classified, unpivot_scores(spark, sf_dir))


def feed_for_you(spark, sf_dir):
    own = _matches(spark, sf_dir).where(F.col("discipline") == "data")
    return feed.page(feed.in_feed_order(own, personal=True), 20, 20).select("id", "title", "score", F.col("application_deadline").cast("string").alias("deadline"))


def feed_view(spark, sf_dir):
    return _matches(spark, sf_dir).select("id", "title", F.col("discipline").alias("matched"), "score")


def feed_filtered(spark, sf_dir):
    rows = feed.filtered(records(spark, sf_dir), {"search": " adviseur ", "client": "regio", "work_arrangement": None, "province": ""})
    return feed.in_feed_order(rows.where("source_status = 'active'"), personal=False).select("id", "title", "client_name")


def feed_has_more(spark, sf_dir):
    rows = records(spark, sf_dir).where("source_status = 'active'")
    return feed.has_more(feed.page(feed.in_feed_order(rows, personal=False), 12, 24), 12)


def detail_lookup(spark, sf_dir):
    """One record by its id (the least one); the filter reaches the scan."""
    stored = read_table(spark, sf_dir, "structured_opportunities")
    rows = feed.detail(stored, stored.agg(F.min("id")).first()[0])
    return versions.latest(rows, ["id"], [F.col("updated_at").desc()]).select("id", "title", "client_name", "location", "province", "education_level", F.size("requirements").alias("n_requirements"))


def feed_of_each_user(spark, sf_dir):
    users = read_table(spark, sf_dir, "user_cvs").select("user_id").distinct()
    own = users.withColumn("discipline", F.get(F.array(*[F.lit(k) for k in ORDER]), F.pmod(F.conv(F.substring("user_id", 1, 2), 16, 10).cast("int"), F.lit(4)).cast("int")))
    # matches are counted before the join, which is then one row for each user
    sizes = _joined_matches(spark, sf_dir).groupBy("discipline").agg(F.count("*").alias("n_matches"), F.max("score").alias("best"))
    return own.join(sizes, "discipline", "left")


def rank_topk(spark, sf_dir):
    scores = F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("score")) for k in ORDER])
    df = wide_scores(records(spark, sf_dir)).withColumn("s", scores)
    kept = arrays.matches(F.col("s"), ORDER, THRESHOLD, MOST)
    return df.select("id", F.array_join(kept, ",").alias("matched"), F.coalesce(F.get(kept, 0), F.lit("other")).alias("main"), arrays.tied_at_top(F.col("s")).alias("tied"))


def ordered_distinct(spark, sf_dir):
    both = F.concat(F.coalesce("skills", F.array().cast("array<string>")), F.coalesce("competencies", F.array().cast("array<string>")), F.coalesce("skills", F.array().cast("array<string>")))
    return records(spark, sf_dir).select("id", F.array_join(text.ordered_distinct(both), "|").alias("terms"))


def constraint_violations(spark, sf_dir):
    rules = {
        "rate_range": cs.not_below("rate_max", "rate_min"),
        "hours_range": cs.not_below("hours_per_week_max", "hours_per_week_min"),
        "dates": cs.not_below("end_date", "start_date"),
        "confidence": cs.between("extraction_confidence", 0, 1),
        "positions": cs.between("number_of_positions", 1, 10_000),
        "title_blank": cs.not_blank("title"),
        "client_blank": cs.not_blank("client_name"),
        "hash_form": cs.has_form("extracted_from_hash", "^[0-9a-f]{64}$"),
        "arrangement": cs.one_of("work_arrangement", ["on_site", "hybrid", "remote", "unknown"]),
        "positions_known_if_open": cs.implies(F.col("application_status") == "open", F.col("number_of_positions").isNotNull()),
    }
    _, broken = cs.split(cs.checked(records(spark, sf_dir), rules))
    return broken.select("id", F.array_join("violations", ",").alias("violations"))


def repeated_keys(spark, sf_dir):
    return cs.repeated_keys(read_table(spark, sf_dir, "structured_opportunities"), ["source_id", "source_reference"], F.col("source_status") == "active")


def presentation(spark, sf_dir):
    low, high = F.col("hours_per_week_min").cast("int"), F.col("hours_per_week_max").cast("int")
    hours = F.when(low.isNull() & high.isNull(), "unknown").when(low.isNull() | high.isNull() | (low == high), F.concat(F.coalesce(high, low).cast("string"), F.lit(" hours"))).otherwise(
        F.concat(low.cast("string"), F.lit(" - "), high.cast("string"), F.lit(" hours"))
    )
    place = F.coalesce(text.optional_text(F.col("location")), text.optional_text(F.col("province")), F.lit("unknown"))
    return records(spark, sf_dir).select("id", hours.alias("hours"), place.alias("place"), text.html_escaped(F.col("title")).alias("title_html"))


QUERIES = {
    f.__name__: f
    for f in (
        unpivot_scores, feed_view, feed_for_you, feed_filtered, feed_has_more, detail_lookup, feed_of_each_user, rank_topk, ordered_distinct, constraint_violations, repeated_keys, presentation
    )
}

_MATCHES = f"matches as (select l.id, l.discipline, l.score, r.title, r.client_name, r.application_deadline from long l join records r using (id) where l.score >= {THRESHOLD} and r.source_status = 'active')"
_WHITE = r"[\s\x{00A0}\x{0085}\x{001C}-\x{001F}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]"
_collapse = lambda c: f"trim(regexp_replace({c}, '{_WHITE}+', ' ', 'g'))"

SQL = {
    "unpivot_scores": f"with {_RECORDS}, {_WIDE}, {_LONG} select id, discipline, score from long",
    "feed_view": f"with {_RECORDS}, {_WIDE}, {_LONG}, {_MATCHES} select id, title, discipline as matched, score from matches",
    "feed_for_you": f"""with {_RECORDS}, {_WIDE}, {_LONG}, {_MATCHES} select id, title, score, strftime(application_deadline, '%Y-%m-%d %H:%M:%S') as deadline
        from matches where discipline = 'data' order by score desc nulls first, application_deadline asc nulls last, id limit 21 offset 20""",
    "feed_filtered": f"with {_RECORDS} select id, title, client_name from records where source_status = 'active' and title ilike '%adviseur%' and client_name ilike '%regio%'",
    "feed_has_more": f"with {_RECORDS}, p as (select id from records where source_status = 'active' order by application_deadline asc nulls last, id limit 13 offset 24) select count(*) > 12 as has_more, least(count(*), 12) as rows from p",
    "detail_lookup": f"with {_RECORDS} select id, title, client_name, location, province, education_level, len(requirements) as n_requirements from records where id = (select min(id) from records)",
    "feed_of_each_user": f"""with {_RECORDS}, {_WIDE}, {_LONG}, {_MATCHES}, users as (select distinct user_id from user_cvs),
        own as (select user_id, (['process', 'data', 'ict', 'finance'])[cast(('0x' || substr(user_id, 1, 2)) as integer) % 4 + 1] as discipline from users),
        sizes as (select discipline, count(*) as n_matches, max(score) as best from matches group by discipline)
        select discipline, user_id, n_matches, best from own left join sizes using (discipline)""",
    "rank_topk": f"""with {_RECORDS}, {_WIDE}, {_LONG}, ranked as (select *, row_number() over (partition by id order by score desc, {_PLACE}) as n,
        max(score) over (partition by id) as top from long)
        select id, coalesce(string_agg(discipline, ',' order by n) filter (where score >= {THRESHOLD} and n <= {MOST}), '') as matched,
        coalesce(max(discipline) filter (where n = 1 and score >= {THRESHOLD}), 'other') as main, cast(count(*) filter (where score = top) as integer) as tied from ranked group by id""",
    "ordered_distinct": f"""with {_RECORDS}, items as (select id, i, {_collapse("t")} as t from (select id, unnest(a) as t, generate_subscripts(a, 1) as i from
        (select id, list_concat(list_concat(coalesce(skills, []), coalesce(competencies, [])), coalesce(skills, [])) as a from records))),
        kept as (select id, t, i from items where t is not null and t <> '' qualify row_number() over (partition by id, replace(lower(t), 'ß', 'ss') order by i) = 1)
        select r.id, coalesce((select string_agg(t, '|' order by i) from kept k where k.id = r.id), '') as terms from records r""",
    "constraint_violations": f"""with {_RECORDS}, v as (select id, concat_ws(',', case when rate_max < rate_min then 'rate_range' end,
        case when hours_per_week_max < hours_per_week_min then 'hours_range' end, case when end_date < start_date then 'dates' end,
        case when extraction_confidence not between 0 and 1 then 'confidence' end, case when number_of_positions not between 1 and 10000 then 'positions' end,
        case when coalesce(trim(title), '') = '' then 'title_blank' end, case when coalesce(trim(client_name), '') = '' then 'client_blank' end,
        case when not regexp_matches(extracted_from_hash, '^[0-9a-f]{{64}}$') then 'hash_form' end,
        case when work_arrangement not in ('on_site', 'hybrid', 'remote', 'unknown') then 'arrangement' end,
        case when application_status = 'open' and number_of_positions is null then 'positions_known_if_open' end) as violations from records)
        select id, violations from v where violations <> ''""",
    "repeated_keys": "select source_id, source_reference, count(*) as n from structured_opportunities where source_status = 'active' and source_id is not null and source_reference is not null group by 1, 2 having count(*) > 1",
    "presentation": f"""with {_RECORDS}, h as (select *, cast(trunc(hours_per_week_min) as integer) as low, cast(trunc(hours_per_week_max) as integer) as high from records)
        select id, case when low is null and high is null then 'unknown' when low is null or high is null or low = high then coalesce(high, low) || ' hours' else low || ' - ' || high || ' hours' end as hours,
        coalesce(nullif({_collapse("location")}, ''), nullif({_collapse("province")}, ''), 'unknown') as place,
        replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') as title_html from h""",
}
