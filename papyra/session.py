"""Session helpers: worker import path, shared scratch tables, sensible defaults."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Environment of Python workers: blocks from 256 KB on go back to the system when they are freed.
WORKERS = {"MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep their memory small.

    Workers get the repository on their path (on a cluster the same path, or a
    wheel, must exist on every node). Arrow batches are bounded in rows and bytes,
    so that long texts do not fill a worker's memory.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    for k, v in WORKERS.items():
        env.setdefault(k, v)
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests, benchmarks and the command line."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("papyra")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return attach(b.getOrCreate())


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one if unset on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="papyra-")
    return _own[app]


_written: list[tuple[SparkSession, str]] = []


def drop_path(spark: SparkSession, path: str) -> None:
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


@contextmanager
def recorded():
    """The scratch paths handed out in the block, for whoever drops them before the program ends."""
    first, paths = len(_written), []
    yield paths
    paths += [p for _, p in _written[first:]]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; dropped when the program ends."""
    path = f"{shared_dir(spark)}/papyra/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def write_table(df: DataFrame, tag: str, **options: object) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors. options: of Spark's Parquet writer."""
    path = scratch_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
