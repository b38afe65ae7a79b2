"""Resumable runs: done-sets, deduplicating streams into tables, caches that keep only good rows."""

from __future__ import annotations

import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.curate import pending
from corpusloom.operators.ordinal import latest_wins
from corpusloom.sources import files


class OutOfTime(Exception):
    """Ends a run whose time is over before its next batch."""


def done_ids(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """Keys already written to a Parquet output; none if it does not exist yet."""
    return spark.read.schema(schema).parquet(path).select(key).distinct() if files.exists(path) else spark.createDataFrame([], T.StructType([T.StructField(key, schema[key].dataType)]))


def run_stream(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: str, order: str, work=None, files_per_batch: int = 8, seconds: float | None = None, progress: list | None = None) -> int:
    """Processes the new files of a Parquet folder once and appends rows of unseen keys; returns the rows added.

    Within a batch the first row of a key by ``order`` counts; keys already in the target are left out by an anti
    join, so a batch that is repeated after a failure adds nothing twice. ``work`` maps the pending rows. Null keys are
    left out. After ``seconds`` no further batch is begun; the next run goes on from there. ``progress`` takes a row a
    batch: its number, rows added so far, seconds since the start, and rows a second.
    """
    began = time.monotonic()
    added = 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal added
        if seconds is not None and time.monotonic() - began >= seconds:
            raise OutOfTime  # the batch is not marked as done
        from corpusloom.operators.ordinal import first_wins

        fresh = pending(first_wins(batch, [key], [order]), done_ids(batch.sparkSession, target, key, schema), key)
        out = work(fresh) if work else fresh
        seen = Observation()  # counted in the pass that writes: ``work`` runs once
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(target)
        added += seen.get["n"]
        if progress is not None:
            took = time.monotonic() - began
            progress.append({"batch": number, "added": added, "seconds": round(took, 3), "rows_a_second": round(added / max(took, 1e-9), 3)})

    query = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if seconds is None or time.monotonic() - began < seconds or "OutOfTime" not in str(query.exception()):
            raise
    return added


def through_cache(wanted: DataFrame, cache: DataFrame, key: str, fetch) -> tuple[DataFrame, DataFrame]:
    """``(hits, fetched)`` of the wanted keys; only rows with status ok are hits, each missing key is fetched once.

    ``cache`` has the key, fetched_at, status and value columns; ``fetch`` maps a table of distinct keys.
    """
    good = latest_wins(cache.where(F.col("status") == "ok"), [key], ["fetched_at"])
    keys = wanted.where(F.col(key).isNotNull()).select(key).distinct()
    return good.join(keys, key, "left_semi"), fetch(keys.join(good, key, "left_anti"))


def mark_done(folder: str, shards: list[str]) -> None:
    """Marks shards as finished, all of one stream at once; a marker is written whole."""
    for name in shards:
        files.write(f"{folder.rstrip('/')}/{name}.done", b"")


def open_shards(folder: str, shards: list[str]) -> list[str]:
    """The shards that are not marked as finished, in their order."""
    return [x for x in shards if not files.exists(f"{folder.rstrip('/')}/{x}.done")]
