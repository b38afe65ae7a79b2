from pyspark.sql import functions as F

from corpusloom.session import checkpoint


def test_estimates_of_loops_stay_numbers_of_eight_bytes(spark):
    state = checkpoint(spark.range(5).select(F.col("id").alias("a"), ((F.col("id") + 1) % 5).alias("b")))
    for _ in range(9):  # the digits of the estimate would double each round
        other = state.select(F.col("a").alias("b"), F.col("b").alias("c"))
        state = checkpoint(state.join(other, "b").select("a", F.col("c").alias("b")))
        assert state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
    assert sorted(map(tuple, state.collect())) == [(i, (i + 2**9) % 5) for i in range(5)]
