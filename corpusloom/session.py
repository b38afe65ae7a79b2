"""Session helpers shared by all operators: checkpoints, parallelism, table loading."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest number of bytes that a side of a join may have to be broadcast.
BROADCAST_BYTES = 8 * 1024 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only where the session names none (tests), make one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    wanted = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return _estimated(df.checkpoint(eager=True))


def _estimated(df: DataFrame) -> DataFrame:
    """The checkpoint ``df`` without Spark's estimate of its bytes, if that is beyond a long.

    A join is estimated as the product of its sides and a checkpoint keeps the estimate, so in a loop that joins its
    state with itself its digits double each round, until they fill the driver's memory. Partitioning and order stay.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes().bit_length() < 64:
        return df
    from pyspark.sql import DataFrame

    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    session, _, constraints = (plan.otherCopyArgs().apply(i) for i in range(3))
    plain = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, jvm.scala.Option.empty(), constraints
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plain), spark)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint of ``df`` and its number of rows, from one job."""
    out, rows, _ = sized(df, [])
    return out, rows


def sized(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int, int]:
    """A checkpoint of ``df``, its rows, and the bytes of its string and string-array ``columns``, from one job."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    size = sum((F.coalesce(F.octet_length(F.concat_ws(",", c)), F.lit(0)) for c in columns), F.lit(0))
    out = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")))
    return out, int(seen.get["n"]), int(seen.get["b"])


def release(spark: SparkSession) -> None:
    """Have the shuffles and checkpoints deleted that nothing refers to any more.

    Spark deletes them when the driver collects its garbage, which a driver with little to do hardly ever does.
    """
    sc = spark.sparkContext
    for pause in (0.2, 0):  # what has just ended is still held here and there, also by events
        gc.collect()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        sc._jvm.System.gc()
        time.sleep(pause)


class Store:
    """Tables of one run in the shared checkpoint folder, as compressed files; all are deleted at the end of the block.

    Checkpoints take more than twice as much. Rows are not in the partitions that wrote them.
    """

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}"

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)
        release(self.spark)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` from its files; what was shuffled for it is deleted."""
        path, schema = f"{self.folder}/{name}", df.schema
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
        del df
        release(self.spark)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self._delete(f"{self.folder}/{name}")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of all executors, once a session.

    A worker only finds what lies on its own path; the driver may have the package from elsewhere.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-ship-"), "corpusloom_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("corpusloom", os.path.relpath(full, package)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def total_cores(spark: SparkSession) -> int:
    """Tasks that can run at once, as far as the session tells."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Deal rows evenly over ``factor`` tasks per core, where the scan gives fewer.

    For Python-heavy stages, whose work grows with the text rather than with the bytes of the file.
    Round-robin dealing is by row, so hot keys do not matter.
    """
    spark = df.sparkSession
    wanted = max(total_cores(spark) * factor, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted)
