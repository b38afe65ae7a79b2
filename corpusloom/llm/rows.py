"""Distinct rows without moving their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import BROADCAST_BYTES, sized


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df`` (strings only) with repeated rows once.

    Only a digest of each row is shuffled, to find the digests of repeated rows; these rows alone are then made
    distinct, and all others leave their scan as they are.
    """
    columns = df.columns
    whole = F.unhex(F.md5(F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("+"), c), F.lit("-")) for c in columns])))
    keyed = df.withColumn("__row", whole)
    again, n, _ = sized(keyed.select("__row").groupBy("__row").count().where("count > 1").select("__row"), [])
    if not n:
        return df
    again = F.broadcast(again) if n * 32 <= BROADCAST_BYTES else again
    once = keyed.join(again, "__row", "left_anti").select(columns)
    return once.unionByName(keyed.join(again, "__row", "left_semi").select(columns).distinct())
