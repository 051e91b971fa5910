"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}


def build_session(app: str = "gradeworks", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC, ANSI session with adaptive execution and skew-join handling."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master that names none."""
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    path = path or _own_dir.get(spark.sparkContext.applicationId)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    return _own_dir.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="gradeworks-"))


def local_shared_dir(spark: SparkSession) -> str:
    """The shared folder as a path of the machine, nothing if it lies in a store that only Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.toUri().getPath() if files.getUri().getScheme() == "file" else ""


def setting(spark: SparkSession, key: str) -> str | None:
    """Value of a setting, its default if it is not set; None if this Spark does not know it."""
    try:
        return spark.conf.get(key)
    except PySparkException:
        return None


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage. Nothing needs the shuffle
    files of the write afterwards, so Spark removes them at once instead of when the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = setting(spark, _CLEANUP)
    if before is not None:  # Spark versions without the setting keep the files a while
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that arrives in fewer pieces than there are cores, as one small file
    does; larger inputs pass through untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out evenly by the hash of ``key``, a share for each core, in order of the key."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key)


def input_state(spark: SparkSession, folder: str) -> tuple:
    """Name, change time and size of each table in ``folder``: differs once a table is written anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return ()
    return tuple(sorted((s.getPath().getName(), s.getModificationTime(), files.getContentSummary(s.getPath()).getLength())
                        for s in files.listStatus(path)))


_staged: dict[tuple, DataFrame] = {}


def staged(spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Table ``name`` made from the tables in folder ``scope``, written once per application and state of
    the input, and re-read afterwards."""
    key = (spark.sparkContext.applicationId, scope, name, input_state(spark, scope))
    if key not in _staged:
        _staged[key] = write_table(build(), name)
    return _staged[key]
