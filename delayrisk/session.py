"""Session helpers.

On a cluster the session is built by the launcher; code here only *reads*
its settings.  ``local_session`` is for tests and the bench and sets what a
cluster would otherwise provide (shuffle width, checkpoint folder).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "delayrisk") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("DELAYRISK_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints",
                os.environ.get("DELAYRISK_CLEAN_CHECKPOINTS", "false"))
        .config(CHECKPOINT_CONF, os.environ.get("DELAYRISK_CHECKPOINT_DIR")
                or tempfile.mkdtemp(prefix="delayrisk-ckpt-"))
        .config("spark.sql.warehouse.dir", os.environ.get("DELAYRISK_WAREHOUSE")
                or tempfile.mkdtemp(prefix="delayrisk-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is used as is.  Only
    when it is unset (local tests) a scratch folder is made and recorded.
    """
    sc = spark.sparkContext
    path = sc.getConf().get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is unset; a cluster run needs a shared folder there")
        path = tempfile.mkdtemp(prefix="delayrisk-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def session_key(spark: SparkSession) -> tuple:
    """Identity of a live session for per-session memos (lazy readers, a
    trained model, checkpointed predictions): the application id changes
    with every new SparkContext, so a stopped session's entries never match."""
    return (spark.sparkContext.applicationId, id(spark._jsparkSession))


# Runtime SQL settings the jobs rely on at scale.  AQE re-plans with measured
# sizes; skew join splits a hot key's partition; forcing it lets AQE split
# even when that needs one more shuffle after the join (for example a join
# that feeds a distinct on the same key), which is the case in the feature
# description and the final deduplication.  Broadcasts are decided only on
# measured sizes: the planner's estimate (compressed file bytes) is not a
# bound on a side's in-memory size, so it is switched off, and AQE turns a
# sort-merge join into a broadcast join when a side's shuffle output,
# measured at run time, is under 32 MB.  Files and shuffled parts are read 16 MB
# at a time: a hash aggregate takes about ten times that in memory.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.files.maxPartitionBytes": "16MB",
}

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let rows reach Python in batches of about 4 MB, except where the launcher set a size.

    Without it a batch holds 10,000 rows whatever their texts' length, and both the executor and its worker hold two or
    more of them.
    """
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "4MB")


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes of input files for each part that a shuffle starts with.
PART_BYTES = 4 << 20


def tune_for_skew(spark: SparkSession) -> None:
    """Apply ``SKEW_SETTINGS`` except where the launcher set a value."""
    launched = spark.sparkContext.getConf()
    for key, value in SKEW_SETTINGS.items():
        if not launched.contains(key):
            spark.conf.set(key, value)


def shuffle_width(spark: SparkSession) -> int:
    """The number of parts that a shuffle starts with."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(INITIAL_PARTITIONS, None) or 0))


def tune_for_size(spark: SparkSession, path: str) -> None:
    """Let shuffles start with parts in proportion to the Parquet files under ``path``, except where the launcher set a number.

    AQE joins small parts but splits none below an aggregate, so with a fixed number of parts a task's memory
    would grow with the input.  Only file lengths are read.
    """
    if spark.sparkContext.getConf().contains(INITIAL_PARTITIONS):
        return
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(path))
    size = files.agg(F.sum("length")).first()[0] or 0
    spark.conf.set(INITIAL_PARTITIONS, str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))))
