from pyspark.sql import functions as F

from threadlens.operators.extract import posts_from_pages
from threadlens.sources.forum import ForumTables
from threadlens.streaming import ingest as X
from threadlens.streaming import state as ST


def test_stream_equals_batch_and_replay_is_idempotent(spark, sf_small, tmpdir_path):
    t = ForumTables(spark, sf_small)
    pages_dir, store, ckpt = tmpdir_path + "/pages", tmpdir_path + "/store", tmpdir_path + "/ckpt"
    X.stage_pages(t.thread_pages, pages_dir, 4, copies=2)
    X.ingest(spark, pages_dir, store, ckpt, max_files=2).awaitTermination()
    batch = posts_from_pages(t.thread_pages)
    s = spark.read.parquet(store).drop(X.BATCH_COL)
    assert s.count() == batch.count() == t.posts.count()
    assert s.select(*batch.columns).exceptAll(batch).count() == 0
    # restart with the same checkpoint: nothing new, nothing lost
    X.ingest(spark, pages_dir, store, ckpt, max_files=2).awaitTermination()
    assert spark.read.parquet(store).count() == batch.count()
    # replaying one batch id rewrites only that batch's rows
    sink = X.upsert_batch(store)
    stored = spark.read.parquet(store).where(F.col(X.BATCH_COL) == 0).drop(X.BATCH_COL)
    first = spark.createDataFrame(stored.collect(), stored.schema)  # a batch is never read from its own output
    sink(first, 0)
    assert spark.read.parquet(store).count() == batch.count()


def test_last_page_stream(spark, sf_small, tmpdir_path):
    t = ForumTables(spark, sf_small)
    pages_dir, front, ckpt = tmpdir_path + "/pages", tmpdir_path + "/front", tmpdir_path + "/ckpt"
    X.stage_pages(t.thread_pages, pages_dir, 3)
    X.track_last_pages(spark, pages_dir, front, ckpt, max_files=1).awaitTermination()
    got = {r.thread_id: r.last_page for r in X.read_frontier(spark, front).collect()}
    want = {r.thread_id: r.m for r in t.posts.groupBy("thread_id").agg(F.max("thread_page").alias("m")).collect()}
    assert got == want


def test_first_posts_survive_a_crash_between_write_and_commit(spark, sf_small, tmpdir_path):
    """A batch is written and then fails; the restart replays it. Rows, and rows staged again, equal the batch job."""
    import pytest
    from pyspark.errors import StreamingQueryException

    t = ForumTables(spark, sf_small)
    pages_dir, store, ckpt = tmpdir_path + "/pages", tmpdir_path + "/store", tmpdir_path + "/ckpt"
    X.stage_pages(t.thread_pages, pages_dir, 3, copies=2)

    def crash(batch_id):
        if batch_id == 1:
            raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        ST.ingest_first(spark, pages_dir, store, ckpt, max_files=2, after=crash).awaitTermination()
    ST.ingest_first(spark, pages_dir, store, ckpt, max_files=2).awaitTermination()
    batch = posts_from_pages(t.thread_pages)
    got = spark.read.parquet(store).select(*batch.columns)
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0


def test_first_posts_within_a_batch_null_ids_and_wide_ids(spark, tmpdir_path):
    rows = [(i % 7, 1, 1000 * (i % 5)) for i in range(50)] + [(None, 1, 5), (None, None, 5), (-3, 2, 5), (-3, 2, 5),
                                                             (10 ** 15, None, 1), (10 ** 15, None, 1)]
    schema = "post_id long, thread_id long, thread_page int"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(tmpdir_path + "/in")
    out = tmpdir_path + "/out"
    stream = spark.readStream.schema(schema).parquet(tmpdir_path + "/in")
    ST.start(spark, ST.first_posts(stream), out, f"{out}-ckpt").awaitTermination()
    assert sorted(r["post_id"] for r in spark.read.parquet(out).collect()) == [-3, *range(7), 10 ** 15]


def test_first_posts_with_a_time_to_live(spark, tmpdir_path):
    """Such a stream runs until it is stopped; ids that come again within the time are not passed on."""
    import time

    schema = "post_id long, thread_id long, thread_page int"
    for _ in range(2):
        spark.createDataFrame([(i % 7, 1, 1) for i in range(20)], schema).coalesce(1).write.mode("append").parquet(tmpdir_path + "/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(tmpdir_path + "/in")
    q = ST.start(spark, ST.first_posts(stream, 3_600_000), tmpdir_path + "/out", tmpdir_path + "/ckpt",
                 trigger={"processingTime": "1 second"})
    try:
        end = time.time() + 90
        while time.time() < end and (q.lastProgress is None or q.lastProgress["batchId"] < 2):
            time.sleep(1)
    finally:
        q.stop()
    assert sorted(r["post_id"] for r in spark.read.parquet(tmpdir_path + "/out").collect()) == list(range(7))


def test_last_page_log_holds_growth_only(spark, tmpdir_path):
    schema = "thread_id long, thread_page int"
    for pages in ([(1, 1), (1, 2), (2, 5)], [(1, 2), (2, 4), (None, 3)], [(1, 7), (2, 5), (3, None)]):
        spark.createDataFrame(pages, schema).coalesce(1).write.mode("append").parquet(tmpdir_path + "/in")
        stream = spark.readStream.schema(schema).parquet(tmpdir_path + "/in")
        ST.start(spark, ST.last_pages(stream), tmpdir_path + "/log", tmpdir_path + "/ckpt").awaitTermination()
    log = sorted((r.thread_id, r.last_page) for r in spark.read.parquet(tmpdir_path + "/log").collect())
    assert log == [(1, 2), (1, 7), (2, 5)]
    assert {r.thread_id: r.last_page for r in X.read_frontier(spark, tmpdir_path + "/log").collect()} == {1: 7, 2: 5}


def test_pages_are_made_once_for_all_copies(spark, sf_small, tmpdir_path):
    """However many copies are staged, the pages are computed once; small inputs still come as the files asked for."""
    pages = ForumTables(spark, sf_small).thread_pages
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    X.stage_pages(pages.mapInArrow(count, pages.schema), tmpdir_path + "/pages", 3, copies=2)
    staged = spark.read.parquet(tmpdir_path + "/pages")
    assert made.value == pages.count() and staged.count() == 2 * made.value
    assert X.files_per_batch(spark, tmpdir_path + "/pages", 3) == -(-len(staged.inputFiles()) // 3) >= 2
    assert staged.distinct().exceptAll(pages).count() == 0


def _shuffle_files(spark):
    import glob

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_shuffles_of_a_batch_end_with_it(spark, tmpdir_path):
    """what a batch has shuffled to its state is deleted when the batch has ended."""
    schema = "post_id long, thread_id long, post_text string"
    for k in range(3):
        rows = [(k * 100 + i, i % 9, "text " * 50) for i in range(100)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(tmpdir_path + "/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(tmpdir_path + "/in")
    before, left = _shuffle_files(spark), []
    ST.start(spark, ST.first_posts(stream), tmpdir_path + "/out", tmpdir_path + "/ckpt",
             after=lambda i: left.append(len(_shuffle_files(spark) - before))).awaitTermination()
    assert len(left) == 3 and left[2] <= left[0]
    assert not _shuffle_files(spark) - before
    assert spark.read.parquet(tmpdir_path + "/out").count() == 300


def test_slices_of_pages_are_staged_one_by_one(spark, sf_small, tmpdir_path, monkeypatch):
    """Pages in slices are the pages, and no slice's shuffle files are left when it is staged."""
    from threadlens import session

    want = ForumTables(spark, sf_small).thread_pages
    monkeypatch.setattr(session, "SLICE_ROWS", 300)
    t = ForumTables(spark, sf_small)
    assert 1 < len(t.thread_page_slices) <= session.MAX_SLICES
    before = _shuffle_files(spark)
    X.stage_pages(t.thread_page_slices, tmpdir_path + "/pages", 4, copies=2)
    assert not _shuffle_files(spark) - before
    staged = spark.read.parquet(tmpdir_path + "/pages")
    assert staged.count() == 2 * want.count() and staged.distinct().exceptAll(want).count() == 0
    # a copy begins when the one before is whole, so a page comes in two batches
    import os

    at = {}
    for f in sorted(staged.inputFiles(), key=lambda f: os.stat(f.removeprefix("file://")).st_mtime_ns):
        for r in spark.read.parquet(f).select("page_id").collect():
            at.setdefault(r.page_id, []).append(len(at))
    assert all(len(x) == 2 for x in at.values()) and all(x[1] == len(at) for x in at.values())


def test_new_rows_of_a_batch(spark, monkeypatch):
    """keys that stand once, repeated ones, null ones and known ones, whichever side goes to the tasks."""
    from threadlens.sources.io import dedupe_latest

    schema = "post_id long, thread_id long, post_text string, thread_bucket int"
    rows = [(i, i % 5, f"t{i}", i % 5) for i in range(20)] + [(3, 3, "again", 3), (7, 2, "t7", 2), (7, 2, "t7", 2),
                                                             (None, 1, "x", 1), (None, 1, "y", 1)]
    made = spark.createDataFrame(rows, schema)
    for stored in ([], [0, 1, 3], list(range(20)), list(range(1, 20))):
        known = spark.createDataFrame([(i % 5, i) for i in stored], "_bucket int, _key long") if stored else None
        want = dedupe_latest(made, "post_id", order_by=["post_id"])
        want = sorted(map(repr, (want if known is None else X._unknown(want, known, "post_id")).collect()))
        for most in (1_000_000, 2, 0):
            monkeypatch.setattr(X, "MAX_SENT_KEYS", most)
            assert sorted(map(repr, X.new_rows(made, known, "post_id").collect())) == want
    single = made.where("post_id > 10")
    assert "Exchange" not in X.new_rows(single, None, "post_id")._jdf.queryExecution().executedPlan().toString()
