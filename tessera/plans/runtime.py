"""What every plan needs: a session, tables, code on the executors, shared scratch tables."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
#: Set only where a local session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
ARROW_ROWS = 1000
GC_SECONDS = 2.0


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out to all cores by their keys: of a file's row group one task has all rows,
    and there may be one of millions of small rows that each are much work."""
    spark = df.sparkSession
    return df.repartition(max(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism), *keys)


def ship(spark: SparkSession) -> None:
    """Let executors import this package, once a context, unless their path has it already.

    Where the session left Spark's number of rows for an Arrow batch as it is, it becomes
    ``ARROW_ROWS``: a batch of texts is held several times over outside the heap.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(ARROW_ROWS))
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if os.path.realpath(PACKAGE.parent) in paths or getattr(spark.sparkContext, "_tessera_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._tessera_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. Only a
    local session, whose driver is its executor, has one without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; ``keep`` what a result still reads."""

    _collected = float("-inf")

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        self._open: set[str] = set()

    def save(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = f"{self.base}/{name}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path, compression=compression)
        self._open.add(name)
        del df
        self.free_shuffles()
        return self.spark.read.schema(schema).parquet(path)

    def free_shuffles(self, now: bool = False) -> None:
        """Shuffle files go once the driver's garbage collection finds their plans unused.
        Steps of a moment have little to free, so collections are ``GC_SECONDS`` apart unless
        one is wanted now."""
        if now or time.monotonic() - Scratch._collected >= GC_SECONDS:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            Scratch._collected = time.monotonic()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self._open.discard(name)

    def drop_all_but(self, *keep: str) -> None:
        self.drop(*(self._open - set(keep)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
