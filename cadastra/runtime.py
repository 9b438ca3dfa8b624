"""Session helpers: shared folders, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast a side only when the optimizer's size estimate of a *written* table is below this.
BROADCAST_BYTES = 32 << 20
#: Spark's setting to delete the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    global _local_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="cadastra-")
    return f"file://{_local_dir}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by `cut`."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't see its folder."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="cadastra-ship-"), "cadastra.zip")  # on the driver only; Spark hands it out
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(at))
        _shipped.add(sc.applicationId)


class Cut:
    """A table written to the shared folder: lineage ends there, and a lost executor loses nothing."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/cadastra/{name}-{uuid.uuid4().hex}"
        was = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # the shuffles of this write are read by nothing else
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, was) if was is not None else self.spark.conf.unset(CLEANUP)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def bytes(self) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getContentSummary(p).getLength()

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` to the shared folder and read it back."""
    return Cut(df, name).df


def small(side: Cut, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The cut table, marked for broadcast only when what was written is below `limit` bytes;
    beyond it, the join falls back to a shuffle (AQE splits its skewed partitions)."""
    return F.broadcast(side.df) if side.bytes() * 4 <= limit else side.df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` over all partitions of a shuffle, for steps whose work is not told by the bytes they read (Python, joins of few rows
    to many), which would else run in few tasks."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *by)
