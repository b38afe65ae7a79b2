"""First-wins, last-wins and dense numbering: order always comes from columns, never from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _best(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    """One whole row a key; partial aggregation runs before the shuffle, so hot keys send one row a task."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(pick(F.struct(rank.alias("__rank"), F.struct(*rest).alias("__row"))).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.__row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` (nulls first); ties by the row's own columns, so the result is defined.

    Rows with a null key are left out; columns have to be orderable.
    """
    return _best(df, keys, [F.col(c) for c in order], F.min)


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    return _best(df, keys, [F.col(c) for c in order], F.max)


def ever_valid(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that ever had a non-null value."""
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key).distinct()


def dense_ids(df: DataFrame, order: list[str], prefix: str, name: str = "dense_id") -> DataFrame:
    """Ids ``prefix0, prefix1, ...`` in the given order, without gathering the rows in one task.

    The rows are range-partitioned and sorted; a count a partition gives its offset. Ties keep any order, so the
    order should end in a unique column.
    """
    from corpusloom.session import checkpoint

    ranged = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row a partition
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("string"))
    start = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), F.col("__part"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn(name, F.concat(F.lit(prefix), (start + local).cast("string"))).drop("__part")


def block_index(df: DataFrame, key: str, order: list[str], name: str = "block_no") -> DataFrame:
    """Number of each row within its key, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def ordered_list(value: str, order: str, distinct: bool = False) -> Column:
    """Aggregate: the values of a group in order; ``distinct`` keeps the first of each."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda x: x[value])
    return F.array_distinct(listed) if distinct else listed


def first_success(candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The best-ranked candidate of each key."""
    return first_wins(candidates, [key], order)
