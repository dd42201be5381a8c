"""Session helpers: building a session for tests/bench and finding the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(app: str = "piisieve", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one configured for tests and the bench.

    On a cluster the session already exists (spark-submit) and its settings win;
    ``getOrCreate`` only fills in what is missing.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.appName(app)
         .master(master or f"local[{cpus}]")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/S3/ABFS) folder there; we only invent one when the
    setting is absent, which happens in local tests.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/ABFS) "
                               "that every executor can reach")
        d = tempfile.mkdtemp(prefix="piisieve-ckpt-", dir="/tmp")   # local runs (tests) only
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable, survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back, for rows that several passes read."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/piisieve/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to at least two tasks per core, and to eight per split of a large input.

    Splits say little of how rows lie: a row group is read by one task, so a file of one row group has one
    busy task however many splits it has, and few compressed bytes may hold many rows. Use it on the
    narrow rows below work that costs far more per row than this shuffle.
    """
    spark = df.sparkSession
    try:
        n = max(2 * spark.sparkContext.defaultParallelism, 8 * df.rdd.getNumPartitions())
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session exposes no RDD view
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (regex detection) at least one partition per core.

    The partition count is read from the plan (no job runs). A large input already has one
    split per ~128 MB and passes through untouched; only a small or single-row-group input
    is redistributed round-robin, which is cheap exactly because it is small.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session exposes no RDD view
        return df
    return df.repartition(target) if current < target else df
