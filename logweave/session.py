"""Session settings and the shared folder used for checkpoints and hand-over tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark's own setting: the shuffle files of a query go when the query ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []
_scopes = threading.local()


def build_session(app: str = "logweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on; extra settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Python and pattern work costs far more per byte than a scan: keep small stages parallel
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Log times carry no zone; every operator reads them as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session may fall back to a temporary one."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="logweave-")
    spark.sparkContext.setCheckpointDir(root)
    return shared_dir(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for one hand-over table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = getattr(_scopes, "open", None)
    (scopes[-1] if scopes else _written).append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete the hand-over tables this process has written, once their readers are done."""
    _delete(spark, _written)
    _written.clear()


@contextmanager
def inner_tables(spark: SparkSession) -> Iterator[None]:
    """Hand-over tables written inside the block are deleted at its end, but those given to ``kept``.

    For steps whose results are tables themselves: nothing reads the tables behind them any more, a
    lost executor included. Blocks nest; a kept table belongs to the block outside. After an error
    all tables stay, as a caller may still look at them.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open, _scopes.kept = [], []
    outer = _scopes.open[-1] if _scopes.open else _written
    own: list[str] = []
    kept: list[str] = []
    _scopes.open.append(own)
    _scopes.kept.append(kept)
    done = False
    try:
        yield
        done = True
    finally:
        _scopes.open.pop()
        _scopes.kept.pop()
        stay = kept if done else own
        outer.extend(p for p in own if p in stay)
        _delete(spark, [p for p in own if p not in stay])


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a hand-over table that outlives the innermost ``inner_tables`` block."""
    out = checkpointed(df)
    if getattr(_scopes, "open", None):
        _scopes.kept[-1].append(_scopes.open[-1][-1])
    return out


@contextmanager
def with_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds for what is run inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def write_table(df: DataFrame, path: str) -> None:
    """Write a Parquet table; the shuffle files behind it go as soon as it is whole, before that all are there."""
    with with_conf(df.sparkSession, CLEANUP_CONF, "true"):
        df.write.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read that.

    A lost executor then costs one stage, and readers prune columns and know the table's size.
    """
    path = fresh_path(df.sparkSession, "stage")
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan gives fewer tasks than that.

    A few large row groups would leave cores idle during text work; a scan of many files is left
    as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(stream: DataFrame) -> DataFrame:
    """The rows of a stream over all cores before work is done on them: the few files of a micro-batch make few and uneven tasks."""
    return stream.repartition(stream.sparkSession.sparkContext.defaultParallelism)
