"""Spark session helpers.

The library never builds its own session inside an operator; callers pass one in.
These helpers exist for tests, the bench and the entry module.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC so timestamps compare with the oracle,
# AQE so shuffle sizes and skewed joins are re-planned at run time.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "threadlens") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("THREADLENS_DRIVER_MEM", "16g")))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.
    Only when it is unset (local tests) is a scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="threadlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions handed to ``mapInArrow`` / ``mapInPandas`` are unpickled by name, so the workers must be
    able to import the package whatever their working folder is. An installed package needs no shipping,
    but it does no harm there.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="threadlens-ship-"), "threadlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if not name.endswith((".pyc", ".pyo")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("threadlens", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


@contextmanager
def dropping_shuffles(spark: SparkSession, drop: bool = True) -> Iterator[None]:
    """Jobs in this block delete their shuffle files when they end."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, str(drop or before == "true").lower())
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame, drop_shuffles: bool = False, compression: str | None = None) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    One computation (``DataFrame.checkpoint`` on an unpersisted frame computes
    it twice), and the files live in the folder named by ``spark.checkpoint.dir``
    so the result survives executor loss.  Iterative jobs call this per round.
    ``drop_shuffles`` deletes the shuffle files of the write when it has ended; else they stay until the
    driver's garbage collector finds them. ``compression`` is the codec of the files, the session's if not given.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/threadlens-{uuid.uuid4().hex}"
    with dropping_shuffles(spark, drop_shuffles):
        df.write.mode("overwrite").parquet(path, compression=compression)
    out = spark.read.parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut_lineage`` has written and nothing reads any more.

    Iterative jobs call it when a round's table is replaced, so that a run holds one or two rounds on disk.
    A frame that ``cut_lineage`` has not returned is left alone, and so is one in a store that
    ``pyarrow.fs`` does not know (its owner's clean-up of the checkpoint folder removes it).
    """
    from pyarrow import ArrowInvalid, fs

    for table in tables:
        path = getattr(table, "_written_path", None)
        if path is None:
            continue
        try:
            if path.startswith("file:"):
                path = "/" + path[5:].lstrip("/")
            store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            store.delete_dir(inner)
        except (ArrowInvalid, OSError):
            pass


SLICE_ROWS = 2_000_000      # rows whose texts lie on disk at a time
MAX_SLICES = 8


def slices(df: DataFrame, key: str, n_rows: int) -> list[DataFrame]:
    """``df`` in parts by a hash of ``key``, of about ``SLICE_ROWS`` rows each, ``MAX_SLICES`` parts at most.

    For jobs that shuffle wide rows and keep little: parts done one after the other hold one part's shuffle on disk.
    Each part reads the tables again, so their number is bounded.
    """
    from pyspark.sql import functions as F

    n = min(-(-n_rows // SLICE_ROWS), MAX_SLICES)
    return [df] if n < 2 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def one_by_one(parts: list[DataFrame]) -> DataFrame:
    """The union of narrow results of ``slices``: each is written, and its shuffle files deleted, before the next begins."""
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, [cut_lineage(p, drop_shuffles=True) for p in parts])


def deal(df: DataFrame, keys: list[str], n_rows: int, rows_a_task: int) -> DataFrame:
    """``df`` dealt out by ``keys`` so that a task gets about ``rows_a_task`` of ``n_rows`` rows, however many there are.

    The number of tasks is fixed, as adaptive execution would join them by their compressed size.
    """
    return df.repartition(max(-(-n_rows // rows_a_task), df.sparkSession.sparkContext.defaultParallelism), *keys)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A word list or lexicon, marked for broadcast if a count shows that it has at most ``max_rows`` rows.

    A list made in the driver carries no size statistics, so without the mark it would be joined by a
    shuffle of the large side. Beyond the bound the frame is returned as it is.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= max_rows else df
