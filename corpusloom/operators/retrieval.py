"""Retrieval evaluation: exact top-k by blocks, ranking metrics, leaderboards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpoint, total_cores

#: Query vectors of a block, which one task holds while documents stream by; documents of one matrix product.
BLOCK, STEP = 4096, 1024
#: Documents of a task at most.
TASK_DOCS = 2_000_000


def _merge_best(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two tables of scores a query, ties to the lower id."""
    s = np.concatenate([scores, more], 1)
    i = np.concatenate([ids, np.broadcast_to(more_ids, more.shape)], 1)
    if s.shape[1] <= k:
        return s, i
    last = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    at = s == last
    room = k - (s > last).sum(1)
    for x in np.flatnonzero((at.sum(1) > room) & np.isfinite(last[:, 0])):
        tied = np.flatnonzero(at[x])
        s[x, tied[np.argsort(i[x, tied], kind="stable")[room[x] :]]] = -np.inf
    keep = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)


def topk(queries: DataFrame, docs: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, doc_id, score, rank``: the k nearest documents by cosine, the query itself left out; ties by id.

    A stated query set against all documents: queries go in blocks of ``BLOCK`` vectors. Every task has one block and one
    part of the documents, which stream by in products of ``STEP`` while it keeps the k best of each query; a window over
    these few rows merges the parts. There are as many parts as keep all cores busy, and more where a part would exceed
    ``TASK_DOCS``. Vectors that are null, zero, or of another length than the first query of their block match nothing.
    """
    spark = queries.sparkSession
    pick = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    seen, known = Observation(), Observation()
    q = checkpoint(pick(queries).observe(seen, F.count("*").alias("n")))
    d = checkpoint(pick(docs).observe(known, F.count("*").alias("n")))
    blocks = max(1, -(-int(seen.get["n"] or 0) // BLOCK))
    parts = max(1, -(-total_cores(spark) // blocks), -(-int(known.get["n"] or 0) // TASK_DOCS))
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(F.lit(0).alias("side"), at(blocks).alias("block"), every(parts).alias("part"), "id", "v")
    right = d.select(F.lit(1).alias("side"), every(blocks).alias("block"), at(parts).alias("part"), "id", "v")
    cells = left.unionByName(right).withColumn("cell", F.col("block") * parts + F.col("part")).repartitionById(blocks * parts, "cell").sortWithinPartitions("side")

    def unit(rows: list, width: int) -> np.ndarray:
        m = np.array([v if len(v) == width and None not in v else [np.nan] * width for v in rows], np.float64).reshape(len(rows), width)
        with np.errstate(invalid="ignore", divide="ignore"):
            return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        m = own = scores = ids = None
        for batch in batches:
            side = np.array(batch.column("side"))
            n = int((side == 0).sum())
            waiting += zip(batch.column("id").slice(0, n).to_pylist(), batch.column("v").slice(0, n).to_pylist())
            if n == batch.num_rows or not waiting:
                continue
            if m is None:
                width = len(waiting[0][1])
                m, own = unit([v for _, v in waiting], width), np.array([x for x, _ in waiting])
                scores, ids = np.full((len(own), 0), -np.inf), np.zeros((len(own), 0), np.int64)
            for start in range(n, batch.num_rows, STEP):
                rows = batch.slice(start, STEP)
                di = np.array(rows.column("id"))
                s = np.round(m @ unit(rows.column("v").to_pylist(), width).T, 9)
                s[np.isnan(s) | (own[:, None] == di[None, :])] = -np.inf
                scores, ids = _merge_best(scores, ids, s, di, k)
        if m is not None:
            x, y = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([pa.array(own[x]), pa.array(ids[x, y]), pa.array(scores[x, y])], names=["query_id", "doc_id", "score"])

    near = cells.select("side", "id", "v").mapInArrow(best, "query_id bigint, doc_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def ranking_metrics(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query: nDCG@10, Recall@1/3/10/100, Precision@1/3/10, MRR@10, MAP@100, for binary relevance.

    ``ranked`` has query_id, doc_id, rank; ``qrels`` has query_id, doc_id. Queries without a relevant document give no
    row, those without a hit 0 everywhere.
    """
    rel = qrels.select("query_id", "doc_id").distinct()
    return metrics_of_hits(ranked.join(rel, ["query_id", "doc_id"]), rel.groupBy("query_id").agg(F.count("*").alias("r")))


def metrics_by_label(ranked: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``ranking_metrics`` where the relevant documents of a query are the others with its label.

    ``queries`` and ``docs`` have id and label. Pairs of a label are counted, not listed: labels only meet the ranked rows.
    """
    size = docs.groupBy("label").agg(F.count("*").alias("n"))
    total = queries.select(F.col("id").alias("query_id"), "label").join(size, "label")
    own = docs.select(F.col("id").alias("query_id"), F.lit(1).alias("own"))  # a query among the documents is not relevant to itself
    total = total.join(own, "query_id", "left").select("query_id", "label", (F.col("n") - F.coalesce("own", F.lit(0))).alias("r")).where("r > 0")
    labelled = docs.select(F.col("id").alias("doc_id"), F.col("label").alias("doc_label"))
    hits = ranked.join(total.select("query_id", "label"), "query_id").join(labelled, "doc_id").where("label = doc_label AND query_id <> doc_id").drop("label", "doc_label")
    return metrics_of_hits(hits, total.select("query_id", "r"))


def metrics_of_hits(hits: DataFrame, total: DataFrame) -> DataFrame:
    """The metrics from the ranked relevant rows (query_id, rank) and the number ``r`` of relevant documents a query."""
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    at = lambda k: F.count_if(F.col("rank") <= k)
    dcg = F.sum(F.when(F.col("rank") <= 10, F.lit(1.0) / F.log2(F.col("rank") + 1)))
    agg = hits.groupBy("query_id").agg(
        dcg.alias("dcg"), at(1).alias("h1"), at(3).alias("h3"), at(10).alias("h10"), at(100).alias("h100"),
        F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 100, F.col("nth") / F.col("rank"))).alias("ap"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("r").cast("int"))), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(agg, "query_id", "left").select(
        "query_id", zero(F.col("dcg") / ideal).alias("ndcg_at_10"),
        *[zero(F.col(f"h{k}") / F.col("r")).alias(f"recall_at_{k}") for k in (1, 3, 10, 100)],
        *[zero(F.col(f"h{k}") / F.lit(k)).alias(f"precision_at_{k}") for k in (1, 3, 10)],
        zero(F.when(F.col("first") <= 10, F.lit(1.0) / F.col("first"))).alias("mrr_at_10"), zero(F.col("ap") / F.col("r")).alias("map_at_100"),
    )


def long_scores(results: DataFrame) -> DataFrame:
    """Results with ``scores MAP<split, MAP<metric, value>>`` as one row a model, task, split and metric."""
    by_split = results.select("model_name", "model_revision", "task_name", F.explode("scores").alias("split", "metrics"))
    return by_split.select("model_name", "model_revision", "task_name", "split", F.explode("metrics").alias("metric", "value"))


def family(name: Column | str) -> Column:
    """Model family: the name without its running number."""
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"-\d+$", "")


def leaderboard(scores: DataFrame, group: str, model: str, value: str) -> DataFrame:
    """Rank of each model within a group, best first, and its distance to the best."""
    w = Window.partitionBy(group).orderBy(F.desc(value), model)
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(group).orderBy(F.desc(value)))).withColumn("behind_best", F.first(value).over(w) - F.col(value))


def encode_texts(df: DataFrame, text: str, encoder, width: int) -> DataFrame:
    """``df`` with an embedding from an injected ``encoder(list of texts) -> array``; null texts give null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.fillna("").tolist()
            out = np.asarray(encoder(known), dtype=np.float32).reshape(len(known), width)
            yield pd.Series([None if t is None else v for t, v in zip(s.tolist(), out.tolist())])

    from pyspark.sql import types as T

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("embedding", F.pandas_udf(run, T.ArrayType(T.FloatType()))(text))
