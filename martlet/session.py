"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MB = 1024 * 1024

# Settings that hold from a laptop to a large cluster. Broadcasts are never
# hinted for tables that can grow: the threshold below is the size check, and
# past it the join becomes a sort-merge join whose skewed partitions AQE splits.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # File sizes understate rows held as a hash table several times over.
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # SQL texts written for a database quote their column names with double quotes.
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
}


def shuffle_partitions(shuffle_bytes: int, target: int = 200 * MB, floor: int = 8) -> int:
    """Partitions that keep each shuffle block near ``target`` bytes."""
    return max(floor, -(-shuffle_bytes // target))


def build_session(
    app: str = "martlet",
    master: str | None = None,
    shuffle_bytes: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with ``SETTINGS``; ``shuffle_bytes`` is the largest expected shuffle."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    options = dict(SETTINGS)
    if shuffle_bytes is not None:
        options["spark.sql.shuffle.partitions"] = str(shuffle_partitions(shuffle_bytes))
    options.update(conf)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Scratch folder of a local session that names none; see ``name_local_scratch``.
_local: list[str] = []


def name_local_scratch(spark: SparkSession) -> None:
    """Give a local session without ``spark.checkpoint.dir`` a folder of its own.

    All its executors are this process, so a folder of this machine is shared by them.
    On a cluster nothing is done: there the setting is required.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.master.startswith("local"):
        if not context.master.startswith("local-cluster") and not _local:
            _local.append(tempfile.mkdtemp(prefix="martlet-"))


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the shared folder named in ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "".join(_local)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{shared.rstrip('/')}/martlet-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in the scratch folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing the
    fact join, and every later use prunes columns on the written table.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this session's intermediate tables, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
