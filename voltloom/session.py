"""Session settings and the staging of compact intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Sorted rows one task should hold at most, where the session names too few shuffle partitions.
ROWS_PER_TASK = 1_000_000
ADVISORY_BYTES = 16 << 20
#: Rows up to which a join may broadcast a stored table.
BROADCAST_ROWS = 200_000


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voltloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local-mode session may fall back to a folder of this machine.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return str(named)
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="voltloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return str(spark.sparkContext.getCheckpointDir())


def staged(df: DataFrame) -> DataFrame:
    """Write a compact table once to the shared folder and read it back.

    Cuts the lineage where a table feeds several branches of a plan: the
    branches then read a small columnar file whose size the optimizer knows,
    instead of repeating the scan of the samples. A lost executor costs
    nothing, because the files are not on it.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_side(df: DataFrame) -> DataFrame:
    """A stored table for the next join: above ``BROADCAST_ROWS`` rows it is merged, never broadcast.

    The optimizer knows a stored table's size from its compressed files, where
    a row of sorted keys and repeated figures takes a byte or two. In the hash
    table that a broadcast builds on the driver it takes a hundred or more. The
    hint passes filters, projections, windows and aggregates on its way to the
    join. ``df`` should be a plain scan, whose rows are counted from file footers.
    """
    return df.hint("merge") if df.count() > BROADCAST_ROWS else df


def room_for(df: DataFrame) -> DataFrame:
    """Lets the session's shuffles grow with a table that is about to be sorted; returns the table.

    With a fixed number of shuffle partitions a task's sorts grow with the
    input. Shuffles then start with a partition for every ``ROWS_PER_TASK``
    rows, which adaptive execution joins again while they are small. Numbers
    are only raised, and a table that fits the session's own changes nothing.
    ``df`` should be a plain scan, whose rows are counted from file footers.
    """
    conf = df.sparkSession.conf
    start = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    have = int(conf.get(start, None) or conf.get("spark.sql.shuffle.partitions"))
    need = -(-df.count() // ROWS_PER_TASK)
    if need > have:
        conf.set(start, str(need))
        conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(ADVISORY_BYTES))
    return df
