"""Session helpers: builder, table reader, shared-folder materialisation and size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a side that may be broadcast (bytes); beyond it the callers shuffle.
BROADCAST_LIMIT = 32 << 20


def build(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; where neither setting nor context names one, a temporary folder if all runs in one process.

    A cluster without such a folder raises ValueError, since its executors would write to folders of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        ours = spark.sparkContext.getCheckpointDir()
        if not ours:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
            ours = tempfile.mkdtemp(prefix="lexigraph-")
            spark.sparkContext.setCheckpointDir(ours)
            ours = spark.sparkContext.getCheckpointDir()
        found = ours
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lexigraph/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Spark's setting under which a finished command leaves no shuffle files.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting whether sides of a join that lie together by some of its keys are shuffled again by all of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def materialize(df: DataFrame, tidy: bool = False, in_place: bool = False) -> DataFrame:
    """Write df once as parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The files are removed by discard, or when the driver's JVM ends. With tidy, the shuffle files of the write go as soon as it has ended.
    With in_place, joins take sides that were repartitioned by some of their keys as they lie.
    """
    path, conf = scratch(df.sparkSession), df.sparkSession.conf
    wanted = ({TIDY: "true"} if tidy else {}) | ({ALL_KEYS: "false"} if in_place else {})
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised df now; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast when the counted rows times row_bytes stay under limit, else leave the join to shuffle.

    df should be materialised or a cheap scan, since its rows are counted.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def merged(df: DataFrame) -> DataFrame:
    """df as a side of sort-merge joins, for tables that grow with the tokens.

    Spark plans by the bytes of files, and a token or a match in parquet takes a fraction of what it takes in a broadcast, which the driver builds.
    """
    return df.hint("merge")


#: File bytes behind one shuffle partition of a wide step; the rows are several times as large in memory.
SPREAD_BYTES = 16 << 20
#: Estimates from here on mean that Spark knows no size.
UNKNOWN_BYTES = 1 << 53


def spread(df: DataFrame) -> int:
    """Shuffle partitions of a wide step whose tasks hold their partition: the session's number, more for large inputs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < UNKNOWN_BYTES else 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil_div(known, SPREAD_BYTES))


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
