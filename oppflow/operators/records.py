"""Work on records: reservation by key, closing what is missing, reading typed JSON, and model steps as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import html, text
from .runs import closure_guard, missing_rows

#: States of a run after which its work isn't done again.
DONE = ("succeeded", "review_required")


def reserved(work: DataFrame, ledger: DataFrame, key: str, status: str = "status", result: str = "result_id") -> DataFrame:
    """work with reservation: 'skip' (a run of this key is done and has a result), 'reset' (there is one that isn't), 'new'.

    Of several runs of a key a done one counts. A null key is always new. Ledger rows are combined before the join.
    """
    done = F.col(status).isin(*DONE) & F.col(result).isNotNull()
    runs = ledger.where(F.col(key).isNotNull()).groupBy(key).agg(F.bool_or(F.coalesce(done, F.lit(False))).alias("_done"))
    return work.join(runs, key, "left").withColumn("reservation", F.when(F.col("_done"), "skip").when(F.col("_done").isNotNull(), "reset").otherwise("new")).drop("_done")


def closed_missing(current: DataFrame, seen: DataFrame, counts: DataFrame, keys: Sequence[str], group: str, least: int = 50, ratio: str = "0.70") -> DataFrame:
    """current with source_status 'closed' on active rows not seen, in groups (sources) whose counts allow it.

    counts: group, found, previous. A group without counts, or whose count fell too far, closes nothing.
    """
    allowed, _ = closure_guard(F.col("found"), F.col("previous"), least, ratio)
    free = counts.where(allowed).select(group).distinct()
    gone = missing_rows(current.where("source_status = 'active'"), seen, keys).join(free, group, "left_semi").select(*keys).withColumn("_gone", F.lit(True))
    marked = current.join(gone, list(keys), "left")
    return marked.withColumn("source_status", F.when(F.col("_gone"), "closed").otherwise(F.col("source_status"))).select(*current.columns)


def typed_json(df: DataFrame, column: str, schema: T.StructType, name: str = "record", required: Sequence[str] = ()) -> DataFrame:
    """df with the record of a JSON column and its issues: 'not_json', 'unknown:<field>', 'missing:<field>'."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(column, kept, {"columnNameOfCorruptRecord": "_corrupt"})
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    known = df.withColumn("_p", parsed)
    unknown = F.transform(F.filter(F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")), lambda k: ~F.array_contains(names, k)), lambda k: F.concat(F.lit("unknown:"), k))
    missing = F.array_compact(F.array(*[F.when(F.col(f"_p.{r}").isNull(), F.lit(f"missing:{r}")) for r in required])) if required else F.array().cast("array<string>")
    broken = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    record = F.when(~broken, F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields]))
    return known.withColumn("issues", F.when(broken, F.array(F.lit("not_json"))).otherwise(F.concat(unknown, missing))).withColumn(name, record).drop("_p")


def normalized_content(content: Column, kind: Column) -> Column:
    """The form whose hash tells a real change: visible text of HTML, canonical JSON, else collapsed white space."""
    return F.when(kind == "html", html.parsed_page(content)["visible"]).when(kind == "json", text.canonical_json(content)).otherwise(text.collapse(content))


def prepared_document(content: Column, most: int = 120_000) -> Column:
    """Struct of text, readable, sha256 and error ('unreadable', 'too_long') of a document's text; nothing is cut."""
    clean = text.document_text(text.without_controls(content))
    readable = text.readable_characters(clean)
    error = F.when(content.isNull() | (readable < 50), "unreadable").when(F.length(clean) > most, "too_long")
    return F.struct(clean.alias("text"), readable.alias("readable"), F.sha2(clean, 256).alias("sha256"), error.alias("error"))


def with_recorded(df: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """A model step without the model: outputs recorded by input hash are joined on; rows without one keep nulls."""
    return df.join(recorded, key, "left")


def with_model(df: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """A model step by Arrow batches. answer gets a frame of inputs and gives one of the schema; its errors fail the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield answer(batch)

    return df.mapInPandas(run, schema)


def leaves(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, path, value of every text inside the columns, whatever structs and arrays it is nested in; nulls have no row."""

    def inside(kind: T.DataType, value: Column, path: Column) -> list[Column]:
        entry = "array<struct<path:string,value:string>>"
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in inside(f.dataType, value.getField(f.name), F.concat(path, F.lit(f".{f.name}")))]
        if isinstance(kind, T.ArrayType):
            each = F.transform(value, lambda x, i: F.flatten(F.array(*(inside(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))) or [F.array().cast(entry)]))))
            return [F.coalesce(F.flatten(each), F.array().cast(entry))]
        if isinstance(kind, T.StringType):
            return [F.array(F.struct(path.alias("path"), value.alias("value"))).cast(entry)]
        return []

    found = [x for c in columns for x in inside(df.schema[c].dataType, F.col(c), F.lit(c))]
    if not found:
        return df.select(key, F.lit("").alias("path"), F.lit("").alias("value")).limit(0)
    return df.select(key, F.explode(F.flatten(F.array(*found))).alias("_leaf")).select(key, "_leaf.path", "_leaf.value").where("value is not null")


def flattened(df: DataFrame, column: str, keep: Sequence[str], domains: Mapping[str, tuple[Sequence[str], str]] | None = None) -> DataFrame:
    """keep and the fields of a struct column; of a field with a domain, values outside it become the other value."""
    kind = df.schema[column].dataType
    fields = []
    for f in kind.fields:
        c = F.col(f"{column}.{f.name}")
        if domains and f.name in domains:
            values, other = domains[f.name]
            c = F.when(c.isin(*values), c).otherwise(F.lit(other))
        fields.append(c.alias(f.name))
    return df.select(*keep, *fields)
