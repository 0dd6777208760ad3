"""Session settings, the shared work folder and size-checked collects."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# inputs below this size are dealt out over all cores; larger ones arrive in enough splits
SMALL_BYTES = 1 << 30


class TooLarge(ValueError):
    """A side that must be small enough to hold in memory is not."""


class NoSharedFolder(ValueError):
    """A cluster session does not say where intermediate tables go."""


def local_session(app_name: str = "logvane", cores: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """Single-JVM session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Without the setting a single-machine session gets a temporary folder of its
    own, which is removed when Python ends; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all machines of {master} reach")
    application = spark.sparkContext.applicationId
    if application not in _OWN_FOLDERS:
        folder = tempfile.mkdtemp(prefix="logvane-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN_FOLDERS[application] = folder
    return _OWN_FOLDERS[application]


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's part of the shared folder, which may be removed when it has ended."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def spread_small(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out evenly: a single small file would keep one core busy."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write to the shared folder once and read back: for results used many times, and to cut lineage."""
    path = work_path(df.sparkSession, name)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: stored tables of more rows are not sent whole to every task
BROADCAST_ROWS = 50_000


def merged_if_large(stored: DataFrame) -> DataFrame:
    """A stored side of a join, marked for sort-merge where it has many rows.

    Spark judges a file by its compressed bytes, and alike texts pack so well that a table many times the driver's
    memory would be broadcast.
    """
    return stored.hint("merge") if stored.count() > BROADCAST_ROWS else stored


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect at most ``max_rows`` rows; raise rather than drop any."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooLarge(f"{what}: more than {max_rows} rows")
    return rows


def fence(df: DataFrame) -> DataFrame:
    """Same rows, but later filters are not rewritten into the expressions below.

    Without it the optimizer copies an expensive expression into every filter
    on its result, and evaluates it once per copy.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def share(model) -> Broadcast:
    """Ship a fitted model, whose size does not grow with the data, to each executor once."""
    return SparkSession.active().sparkContext.broadcast(model)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of the table has."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
