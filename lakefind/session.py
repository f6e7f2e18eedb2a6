"""Session helpers: a local session for tests, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", app: str = "lakefind") -> SparkSession:
    """A ``local[cpus]`` session, for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="lakefind-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the folder the cluster names in ``spark.checkpoint.dir``, or the one
    given to ``SparkContext.setCheckpointDir``.  There is no other choice: a
    machine-local folder would be lost with its executor.  ``local_session``, for tests and the bench,
    names one.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return folder


_WRITTEN: list[str] = []


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``materialize`` wrote inside the block when it ends.

    A job wraps building *and writing* its result in it::

        with intermediate_tables(spark):
            joinable(queries, lake, 10).write.parquet(target)
    """
    before = len(_WRITTEN)
    try:
        yield
    finally:
        written = _WRITTEN[before:]
        del _WRITTEN[before:]
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in written:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage of iterative jobs, pins values that a second run of the
    same plan could compute differently (range partition bounds), and gives
    the optimizer true sizes.  ``compression`` is that of the files, the session's if ``None``.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/lakefind-{uuid.uuid4().hex}"
    schema = df.schema
    _WRITTEN.append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(schema).parquet(path)


#: Rows that one Arrow batch may hold. Texts differ widely in length, so batches are kept short.
BATCH_ROWS = 256


def short_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold at most ``BATCH_ROWS`` rows, so that long texts fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
