"""Session helpers: shared scratch storage, materialised intermediates, table access."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from strataseek.errors import DeadlineExceeded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (local tests) a temporary folder is taken and kept for the application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="strataseek-")
            _delete_on_exit(spark, _own[app])
        named = _own[app]
    return named.rstrip("/")


#: Input per core up to which a table of few files is spread before costly work on its rows.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where it is a small table in few files; a large or well divided one as it is.

    Only for work that costs much more than a shuffle of the rows.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    small = int(str(plan.stats().sizeInBytes())) < n * SPREAD_BYTES
    return df.repartition(n, key) if small and df._jdf.rdd().getNumPartitions() * 2 <= n else df


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


@contextmanager
def deadline(spark: SparkSession, seconds: float):
    """Cancel the Spark jobs of this thread after ``seconds`` and raise DeadlineExceeded. Inner deadlines do not end outer ones."""
    sc = spark.sparkContext
    outer = sc.getLocalProperty("spark.jobGroup.id")
    if outer and outer.startswith("deadline-"):
        yield
        return
    group, fired = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        fired.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    sc.setJobGroup(group, "bounded read", interruptOnCancel=True)
    timer.start()
    try:
        yield
        if fired.is_set():
            raise DeadlineExceeded(f"the read took more than {seconds} s")
    except Exception as e:
        if fired.is_set() and not isinstance(e, DeadlineExceeded):
            raise DeadlineExceeded(f"the read took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", outer)


def scratch_path(spark: SparkSession) -> str:
    """A new folder below the shared one, gone when the driver ends."""
    path = f"{shared_dir(spark)}/strataseek/{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def materialise(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets later passes read only
    the columns and row groups they need. Files go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
