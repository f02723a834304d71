"""Written intermediate tables and joins that survive hot keys and lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local, as in tests, a
    folder of this process is made; a cluster must name one.
    """
    global _own_folder
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="palimpsest-")
    return _own_folder


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files have fewer parts than there are cores, and as it is otherwise.

    For costly work on each row of small or badly cut files; large tables are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, name: str = "table", parts: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet to the shared folder, one table per value of ``parts``, and read it back.

    This cuts the lineage: a lost executor costs a read, not a recomputation, and an iterative plan stays short.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*parts or []).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_path = path
    return written


def release(*tables: DataFrame, shuffles: bool = False) -> None:
    """Delete materialised tables that nothing reads any more.

    ``shuffles`` also has the driver collect its garbage, upon which Spark deletes the shuffle files of finished
    steps; otherwise they stay on the executors' disks until the driver's heap happens to fill.
    """
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        if shuffles:
            gc.collect()
            jvm.System.gc()
            shuffles = False
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_by_degree(left: DataFrame, stats: DataFrame, on: list[str], total: int, hub_rows: int = 50_000) -> DataFrame:
    """Inner join of ``left`` with ``stats``, which has one row per key and the number ``n`` of left rows with that key.

    Keys with more than ``2 * total / hub_rows`` left rows (at least 10 000) are hubs; at most ``hub_rows / 2`` of them
    can exist when ``left`` has ``total`` rows, so their broadcast is bounded whatever the data. Their rows are joined
    where they are; only the other rows, none of whose keys is hot, are shuffled.
    """
    limit = max(10_000, 2 * total // hub_rows)
    values = [c for c in stats.columns if c not in (*on, "n")]
    if total <= limit:
        return left.join(stats.drop("n"), on)
    hubs = stats.filter(F.col("n") > limit).select(*on, F.struct(*values).alias("__hub"))
    tagged = left.join(F.broadcast(hubs), on, "left")
    hot = tagged.filter("__hub is not null").select(*left.columns, *[F.col(f"__hub.{v}").alias(v) for v in values])
    rest = tagged.filter("__hub is null").drop("__hub").join(stats.filter(F.col("n") <= limit).drop("n"), on)
    return hot.unionByName(rest.select(*left.columns, *values))
