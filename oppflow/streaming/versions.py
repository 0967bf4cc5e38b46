"""Change detection over a stream of landed pages.

Each micro-batch is compared with the stored state of its keys and appended as
versions. The state is a base, the whole of it, and steps, the keys that a batch
changed; a batch writes its step only, and every ``STEPS`` batches a new base is
made and what lies before the one before it is removed. Folders bear the number of
their batch and a batch reads only those before it, so one that runs twice after a
failure starts from the same state and gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import last_observed, observed_actions, same_key

#: Batches after which the steps are merged into a new base.
STEPS = 50


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers_in(spark: SparkSession, path: str) -> list[int]:
    """The batch numbers of the finished folders in a path, in order."""
    hadoop, files = _folder(spark, path)
    if not files.exists(hadoop):
        return []
    found = [f.getPath() for f in files.listStatus(hadoop)]
    done = [p for p in found if p.getName().startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[6:]) for p in done)


def state_before(spark: SparkSession, root: str, batch: int, keys: Sequence[str]) -> DataFrame | None:
    """The last state of every key before a batch; None if there is none."""
    base = max((n for n in numbers_in(spark, f"{root}/state/base") if n < batch), default=-1)
    steps = [n for n in numbers_in(spark, f"{root}/state/steps") if base < n < batch]
    paths = ([f"{root}/state/base/batch={base}"] if base >= 0 else []) + [f"{root}/state/steps/batch={n}" for n in steps]
    if not paths:
        return None
    return last_observed(spark.read.parquet(*paths), keys, ["_batch"]).drop("_batch")


def apply_batch(rows: DataFrame, batch: int, root: str, keys: Sequence[str], order: str, fingerprint: str, steps: int = STEPS) -> None:
    spark = rows.sparkSession
    before = state_before(spark, root, batch, keys)
    known = None
    if before is not None:
        own = same_key(before, rows.select(*keys).distinct(), keys, "left_semi")
        known = own.select(*keys, F.col(fingerprint).alias("_fingerprint"), F.col("version_no").alias("_version"))
    told = observed_actions(rows, keys, [F.col(order), F.col(fingerprint)], F.col(fingerprint), known)
    told.write.mode("overwrite").parquet(f"{root}/versions/batch={batch}")
    told = spark.read.parquet(f"{root}/versions/batch={batch}")
    last = last_observed(told.select(*keys, fingerprint, "version_no", order), keys, ["version_no", order]).select(*keys, fingerprint, "version_no", F.lit(batch).alias("_batch"))
    last.write.mode("overwrite").parquet(f"{root}/state/steps/batch={batch}")
    if (batch + 1) % steps == 0:
        state_before(spark, root, batch + 1, keys).withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/state/base/batch={batch}")
        _remove(spark, root, batch - steps)


def _remove(spark: SparkSession, root: str, before: int) -> None:
    """Remove the state folders that no batch reads any more."""
    for part in ("base", "steps"):
        for n in numbers_in(spark, f"{root}/state/{part}"):
            if n < before or part == "steps" and n == before:
                hadoop, files = _folder(spark, f"{root}/state/{part}/batch={n}")
                files.delete(hadoop, True)


def follow_changes(spark: SparkSession, landed: DataFrame, root: str, keys: Sequence[str], order: str, fingerprint: str) -> StreamingQuery:
    """Start the stream over what has landed so far (and stop at its end)."""
    def one(rows: DataFrame, batch: int) -> None:
        apply_batch(rows, batch, root, keys, order, fingerprint)

    return landed.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
