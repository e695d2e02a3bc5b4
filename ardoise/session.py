"""Session helpers: where shared intermediate tables go, and how lineage is cut.

Nothing here uses a machine-local folder on a cluster: the folder is the one the session names in
``spark.checkpoint.dir``.  Only where that is unset (tests, notebooks on one machine) a folder of
our own is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 50_000
# ... and its files take at most so many bytes.
BROADCAST_BYTES = 16_000_000

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; made only where unset on one machine, an error on a cluster."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="ardoise-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but stays columnar, so later reads prune columns.  The
    table survives the loss of executors; it is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """Marks a path of the shared folder as ours: it is removed when the driver ends."""
    _written.append((spark, path))


def small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written and measured: broadcast if it has at most ``rows`` rows and BROADCAST_BYTES as written, else left to a shuffled join."""
    kept = materialise(df, name)
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_written[-1][1])
    size = path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(kept) if size <= BROADCAST_BYTES and kept.count() <= rows else kept


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked so that a join with it is sorted and merged, never broadcast.

    Catalyst goes by the bytes of compressed files and does not see what ``explode`` adds, so a table
    that grows with the rows may pass its threshold and still not fit the driver.
    """
    return df.hint("merge")


@atexit.register
def release() -> None:
    """Removes the intermediate tables written so far; frames that still read them no longer work."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
