from pyspark.sql import functions as F

from threadlens import schemas
from threadlens.sources import io as IO
from threadlens.sources.forum import ForumTables


def test_post_round_trips(spark, sf_small, tmpdir_path):
    posts = ForumTables(spark, sf_small).posts
    IO.write_posts(posts, tmpdir_path + "/p", max_records=50)
    back = IO.read_posts(spark, tmpdir_path + "/p")
    assert back.count() == posts.count()
    assert back.select(*schemas.POST_SCHEMA.fieldNames()).exceptAll(posts).count() == 0
    IO.post_records(posts).write.json(tmpdir_path + "/rec")
    rec = IO.read_post_records(spark, tmpdir_path + "/rec")
    trunc = posts.withColumn("post_timestamp", F.timestamp_millis(F.unix_millis("post_timestamp")))
    assert rec.exceptAll(trunc).count() == 0


def test_csv_and_ids(spark, sf_small, tmpdir_path):
    posts = ForumTables(spark, sf_small).posts
    IO.write_csv(posts, tmpdir_path + "/csv", delimiter="|", trim_newlines=True)
    back = spark.read.option("sep", "|").csv(tmpdir_path + "/csv")
    assert back.count() == posts.count()
    IO.write_post_ids(posts, 1000003, tmpdir_path + "/ids")
    ids = sorted(int(r.value) for r in spark.read.text(tmpdir_path + "/ids").collect())
    assert ids == sorted(r.post_id for r in posts.where("thread_id = 1000003").collect())


def test_upsert_and_dedupe(spark):
    cols = "post_id long, post_timestamp timestamp, user_name string"
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    existing = spark.createDataFrame([(1, t0, "a")], cols)
    # a heavily duplicated key and an existing key
    new = spark.createDataFrame([(1, t0, "z")] + [(2, t0 + dt.timedelta(minutes=i), f"v{i}") for i in range(200)], cols)
    add = IO.insert_or_ignore(existing, new, "post_id")
    assert [r.post_id for r in add.collect()] == [2]
    latest = {r.post_id: r.user_name for r in IO.dedupe_latest(new, "post_id").collect()}
    assert latest == {1: "z", 2: "v199"}


def test_load_into_existing_table(spark, tmpdir_path):
    spark.sql("DROP TABLE IF EXISTS tl_posts_k3")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "post_id long, user_name string")
    df.limit(0).write.option("path", tmpdir_path + "/k3").saveAsTable("tl_posts_k3")
    res = IO.load_into_table(spark, df, "tl_posts_k3").first()
    assert res.rows_loaded == 2 and spark.table("tl_posts_k3").count() == 2
    import pytest
    with pytest.raises(ValueError):
        IO.load_into_table(spark, df, "tl_missing_table")
    with pytest.raises(ValueError):
        IO.load_into_table(spark, df.select("user_name", "post_id"), "tl_posts_k3")


def test_polarity_and_frame_csv(spark, tmpdir_path):
    pol = spark.createDataFrame([("k0", 1, 0.1, 0.8, 0.1, 0.0)], schemas.POLARITY_SCHEMA)
    IO.write_polarities(pol, tmpdir_path + "/pol", header=True)
    assert IO.read_polarities(spark, tmpdir_path + "/pol").collect() == pol.collect()
    IO.write_frame_csv(pol, tmpdir_path + "/frame")
    assert spark.read.option("header", True).csv(tmpdir_path + "/frame").count() == 1


def test_lines_and_sample(spark, sf_small, tmpdir_path):
    docs = ForumTables(spark, sf_small).raw("documents")
    docs.select(F.regexp_replace("text", "\n", " ").alias("value")).write.text(tmpdir_path + "/lines")
    lines = IO.read_lines(spark, tmpdir_path + "/lines")
    assert lines.count() == docs.count()
    s1 = [r.doc_id for r in IO.seeded_sample(docs, "doc_id", 10, 1).collect()]
    assert s1 == [r.doc_id for r in IO.seeded_sample(docs, "doc_id", 10, 1).collect()] and len(s1) == 10


def test_strip_message(spark):
    text = "From: a\nSubject: b\n\nbody line\n> quoted\nmore\nAlice wrote:\n--\nsig"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert IO.strip_message(df).first().text_out == "body line\nmore"


def test_index_documents(spark, sf_small):
    posts = ForumTables(spark, sf_small).posts
    idx = IO.index_documents(posts, ascii_only=True)
    r = idx.first()
    assert r["index"].endswith("-ascii") and idx.count() == posts.count()


def test_index_sink_regroups_repeated_posts_only(spark, sf_small, tmpdir_path):
    posts = ForumTables(spark, sf_small).posts
    edited = (posts.where("post_id % 7 = 0").withColumn("user_name", F.lit("edited"))
              .withColumn("post_timestamp", F.expr("post_timestamp + interval 1 hour")))
    nameless = posts.where("post_id in (1, 2)").withColumn("post_id", F.lit(None).cast("long"))
    both = posts.unionByName(edited).unionByName(nameless)
    want = IO.dedupe_latest(both, "post_id")
    for max_keys in (100_000, 3):
        got = IO.dedupe_repeated(both, "post_id", max_keys)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    plan = IO.index_documents(posts)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan     # no text is regrouped where every post stands once


def test_json_sinks_are_compressed(spark, sf_small, tmpdir_path):
    import glob

    posts = ForumTables(spark, sf_small).posts
    IO.write_index(posts, tmpdir_path + "/index")
    IO.write_thread_json(posts, tmpdir_path + "/threads")
    for name in ("index", "threads"):
        files = glob.glob(f"{tmpdir_path}/{name}/bucket=*/part-*")
        assert files and all(f.endswith(".json.gz") for f in files)
        assert spark.read.json(f"{tmpdir_path}/{name}").count() == posts.count()


def test_latest_of_some_columns(spark):
    """ties in the order are settled by the whole row as before; rows are regrouped whole only for such keys."""
    rows = [(1, 5, "a", "x"), (1, 5, "b", "w"), (1, 4, "z", "z"), (2, 1, "a", "x"), (2, 1, "a", "y"), (3, None, "c", "q"),
            (3, None, "d", None), (None, 1, "n", "1"), (None, 2, "m", "2"), (None, 2, "l", "3"), (4, 1, None, "x"), (4, 1, "o", "a")]
    df = spark.createDataFrame(rows, "k long, t int, post_text string, name string").repartition(3)
    want = sorted(map(repr, IO.dedupe_latest(df, "k", ["t"]).select("k", "name").collect()))
    assert sorted(map(repr, IO.dedupe_latest(df, "k", ["t"], columns=["k", "name"]).collect())) == want
    want = sorted(map(repr, IO.dedupe_latest(df, "k", ["k"]).select("k", "name").collect()))
    assert sorted(map(repr, IO.dedupe_latest(df, "k", ["k"], columns=["k", "name"]).collect())) == want
    plan = IO.dedupe_latest(df.where("k = 2 or t = 4"), "k", ["t"], columns=["k", "t"])._jdf.queryExecution().optimizedPlan().toString()
    assert "post_text" not in plan      # no text is grouped where the latest rows agree


def test_sinks_in_slices_of_buckets(spark, sf_small, tmpdir_path, monkeypatch):
    """Slices of buckets hold the same rows, a thread in one file in the order of its posts."""
    from threadlens import session

    posts = ForumTables(spark, sf_small).posts
    monkeypatch.setattr(session, "SLICE_ROWS", 300)
    for _ in range(2):      # the second run takes the place of the first
        IO.write_index(posts, tmpdir_path + "/index")
        IO.write_thread_json(posts, tmpdir_path + "/threads")
    want, index = IO.thread_post_json_rows(posts), IO.index_documents(posts)
    got = spark.read.schema(want.schema).json(tmpdir_path + "/threads").drop("bucket")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    stored = spark.read.schema(index.schema).json(tmpdir_path + "/index").drop("bucket")
    assert stored.count() == index.count() and stored.exceptAll(index).count() == 0
    placed = got.select("thread_id", "post_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    files = {}
    for r in placed.orderBy("f", "i").collect():
        files.setdefault(r.thread_id, []).append((r.f, r.post_id))
    assert all(len({f for f, _ in x}) == 1 and x == sorted(x) for x in files.values())
    left = {c for f in spark.read.json(tmpdir_path + "/threads").inputFiles() for c in [f.split("part-")[1].split("-", 1)[1].split(".")[0]]}
    assert len(left) > 1        # written by several jobs
