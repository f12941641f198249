"""Stateful ingest (X2-X4): what has been seen lives in keyed state on RocksDB, so no batch reads the store.

Posts are dealt by (thread, block of ``WIDTH`` consecutive post ids); the state of such a key is a bitmap of the ids
seen, read once and written once per batch and key, so a thread of any length is many small keys.  The first row of
a post goes on, whatever its time: nothing is dropped as late, and duplicates are found within a batch, across
batches and after a restart.  A time-to-live lets state of old blocks expire where duplicates cannot come back.

The last page of a thread is a second state; a row is emitted only when the page has grown, so the update log holds
one row per page a thread has gained.

Output is written under the batch id.  A batch that is replayed after a crash reads the state of the batch before it
and rewrites its own output, which is what a flush on shutdown has to make sure of: ``stop`` loses no row.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadlens.operators.extract import posts_from_pages
from threadlens.session import DROP_SHUFFLES
from threadlens.streaming.ingest import BATCH_COL, page_stream

_SHIFT = 10
WIDTH = 1 << _SHIFT

# The worker that sets up the state on the driver's side is not given the application's Python files, so the
# processors travel as they are and not by the name of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Passes on the first row of each post id of a block."""

    def __init__(self, columns: list[str], ttl_ms: int | None = None):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "bits BINARY", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.seen.get() if self.seen.exists() else None
        bits = np.zeros(WIDTH, dtype=bool) if held is None else np.unpackbits(
            np.frombuffer(bytes(held[0]), dtype=np.uint8)).astype(bool)
        before = int(bits.sum())
        for part in rows:
            place = (part["post_id"] % WIDTH).to_numpy().astype(np.int64)
            new = ~bits[place] & ~pd.Series(place).duplicated().to_numpy()
            bits[place] = True
            if new.any():
                yield part.loc[new, self.columns]
        if int(bits.sum()) > before or self.ttl_ms is not None:
            self.seen.update((np.packbits(bits).tobytes(),))

    def close(self) -> None:
        pass


class LastPage(StatefulProcessor):
    """Emits a thread's last page whenever it has grown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "page INT")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.page.get()[0] if self.page.exists() else None
        top = max((int(p["thread_page"].max()) for p in rows if p["thread_page"].notna().any()), default=None)
        if top is not None and (held is None or top > held):
            self.page.update((top,))
            yield pd.DataFrame({"thread_id": [key[0]], "last_page": [top]})

    def close(self) -> None:
        pass


def first_posts(posts: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The first row of every post id. Rows without an id are left out."""
    rows = (posts.where(F.col("post_id").isNotNull()).withColumn("_thread", F.coalesce("thread_id", F.lit(-1)))
            .withColumn("_block", F.shiftright("post_id", _SHIFT)))
    return rows.groupBy("_thread", "_block").transformWithStateInPandas(
        statefulProcessor=FirstSeen(posts.columns, ttl_ms), outputStructType=posts.schema, outputMode="append",
        timeMode="none" if ttl_ms is None else "processingTime")


def last_pages(posts: DataFrame) -> DataFrame:
    """``thread_id, last_page`` whenever a thread's last page has grown."""
    return posts.where("thread_id IS NOT NULL").groupBy("thread_id").transformWithStateInPandas(
        statefulProcessor=LastPage(), outputStructType="thread_id long, last_page int", outputMode="append", timeMode="none")


def batch_sink(path: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """X4 sink: a batch's rows under its id, so that a replay rewrites them. ``after`` is called with the batch id."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{BATCH_COL}={batch_id}")
        if after is not None:
            after(batch_id)

    return sink


def start(spark: SparkSession, rows: DataFrame, path: str, checkpoint_dir: str, after: Callable[[int], None] | None = None,
          trigger: dict | None = None):
    """Start the stream with state on RocksDB; by default it runs what there is to read to its end.

    State with a time-to-live always has something to do, so such a stream needs a ``trigger`` of its own
    (``{"processingTime": "10 seconds"}``) and runs until it is stopped.
    """
    # The rows of a batch are shuffled to their state once; those files are deleted when the batch has ended.
    wanted = {_PROVIDER: _ROCKSDB, DROP_SHUFFLES: "true"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return (rows.writeStream.foreachBatch(batch_sink(path, after)).option("checkpointLocation", checkpoint_dir)
                .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ingest_first(spark: SparkSession, pages_dir: str, store_dir: str, checkpoint_dir: str, max_files: int = 1, forum_id=None,
                 ttl_ms: int | None = None, after: Callable[[int], None] | None = None):
    """X1 with X2: pages to the store of first posts. Returns the started query."""
    posts = posts_from_pages(page_stream(spark, pages_dir, max_files), forum_id=forum_id)
    trigger = None if ttl_ms is None else {"processingTime": "10 seconds"}
    return start(spark, first_posts(posts, ttl_ms), store_dir, checkpoint_dir, after, trigger)


def track_last(spark: SparkSession, pages_dir: str, frontier_dir: str, checkpoint_dir: str, max_files: int = 1):
    """Pages to the update log of last pages. Returns the started query."""
    posts = posts_from_pages(page_stream(spark, pages_dir, max_files)).select("thread_id", "thread_page")
    return start(spark, last_pages(posts), frontier_dir, checkpoint_dir)
