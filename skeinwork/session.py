"""Session builder and the shared staging folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_dir: str | None = None


def build_session(app: str = "skeinwork", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling on.

    ``shuffle_partitions`` is left to the cluster's setting when None; AQE coalesces what is too fine.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent the session must be local (tests, notebooks): one temporary folder of this process is
    used then. On a cluster without the setting this raises, since a machine-local folder would be lost with its machine.
    """
    global _own_dir
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="skeinwork-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def width(schema: T.StructType) -> Column:
    """About how many bytes a row of ``schema`` holds."""
    size = F.lit(0).cast("bigint")
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size += F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.NumericType, T.BooleanType)):
            size += F.coalesce(F.size(c), F.lit(0)) * 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size += 8
    return size


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and lets later steps read only the columns they need. Rows and bytes are counted as
    they are written (``extent``), so that no later step has to count them. The folder is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(width(df.schema)).alias("bytes")).write.option("compression", "zstd").parquet(path)
    drop_later(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._extent = (seen.get["rows"], seen.get["bytes"] or 0)
    return out


def extent(df: DataFrame) -> tuple[int, int] | None:
    """Rows and bytes of a staged table, None for any other one."""
    return df.__dict__.get("_extent")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over the cluster's cores if its scan has fewer splits than there are cores.

    For steps that compute much for each row, such as the parsing of pages: a table of few large row groups would else keep most
    cores idle. Tables of many splits, and results of a shuffle, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def partitioned(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` kept in memory or on disk, hash-partitioned and sorted by ``columns``: joins by them, round after round, move only the other
    side. Lost blocks are made again from what ``df`` reads, so that should be a staged table. Unpersist it when done."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns).sortWithinPartitions(*columns).persist()


def drop_later(spark: SparkSession, path: str) -> None:
    """Removes a folder when the driver's process ends."""
    if path.startswith("file://"):
        atexit.register(shutil.rmtree, path[len("file://") :], ignore_errors=True)
    elif os.sep in path and "://" not in path:
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    else:
        atexit.register(_drop_remote, spark, path)


def _drop_remote(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass
