"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows and bytes may be broadcast; beyond it the plain join stays.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that
    they need not find it on their own path."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / "taleweave.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan in at least as many parts as there are cores: an input of one or two
    small files would else be worked on by as many tasks. A larger one stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if it is proven to have at most max_rows rows and
    BROADCAST_BYTES as text (one bounded count), else unchanged, so that the join shuffles."""
    got = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got.n <= max_rows and got.b <= BROADCAST_BYTES else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where it is
    unset, a single machine takes a temporary folder and a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        got = context._jsc.sc().getCheckpointDir()
        if got.isDefined():
            folder = got.get()
        elif context.master == "local" or context.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="taleweave-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder and cuts its lineage, so that a lost
    executor costs a read, not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
