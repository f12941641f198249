from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlens.operators import relational as R
from threadlens.sources.forum import ForumTables


def test_last_page_keeps_every_thread(spark, sf_small):
    t = ForumTables(spark, sf_small)
    got = R.last_page_per_thread(t.posts, t.threads, [44, 45, 46, 47]).count()
    listed_with_posts = t.threads.join(t.posts.select("thread_id").distinct(), "thread_id").count()
    assert got == listed_with_posts  # the reference dropped the last thread


def test_crawl_frontier_rules(spark):
    posts = spark.createDataFrame([(1, 44, 3), (2, 44, 1)], "thread_id long, forum_id int, thread_page int")
    threads = spark.createDataFrame([(2, 44, False), (3, 44, False), (4, 44, True), (1, 44, True)],
                                    "thread_id long, forum_id int, is_ignored boolean")
    got = {r.thread_id: r.page for r in R.crawl_frontier(posts, threads, 44).collect()}
    assert got == {1: 3, 2: 1, 3: 1}  # ignored thread with posts stays; ignored without posts absent
    got2 = {r.thread_id for r in R.crawl_frontier(posts, threads, 44, include_ignored=False).collect()}
    assert got2 == {2, 3}


def test_seeded_split_sizes_and_row_index(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("label"))
    s = R.seeded_split(df, "doc_id", "label", 7, bucket_hex=1)
    sizes = {(r.label, r.split): r.n for r in s.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert sizes[(0, "train")] == 167 and sizes[(0, "test")] == 167
    assert sizes[(1, "train")] == 166 and sizes[(1, "test")] == 167
    # same as a plain per-class window
    h = R.seeded_hash(7, "doc_id")
    ref = (df.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(h, "doc_id")))
           .withColumn("n", F.count("*").over(Window.partitionBy("label")))
           .select("doc_id", F.when(F.col("rn") <= F.floor(F.col("n") / 2), "train").otherwise("test").alias("split")))
    assert s.select("doc_id", "split").exceptAll(ref).count() == 0
    idx = R.row_index(df, "label", "doc_id", width=16)
    ref2 = df.withColumn("row_index", F.row_number().over(Window.partitionBy("label").orderBy("doc_id")))
    assert idx.select("doc_id", "label", "row_index").exceptAll(ref2.select("doc_id", "label", "row_index")).count() == 0


def test_random_draw_is_post_weighted_and_reproducible(spark, sf_small):
    posts = ForumTables(spark, sf_small).posts
    a = R.random_thread(posts, 50, 42).collect()
    b = R.random_thread(posts, 50, 42).collect()
    assert a == b and len(a) == 1
    assert R.random_user(posts, 10**9, 42).count() == 0


def test_stat_matrix_shape(spark, sf_small):
    t = ForumTables(spark, sf_small)
    m = R.stat_matrix(t.topic_threads, t.posts, R.stat_registry(7), keys=[f"k{i}" for i in range(9)])
    assert m.count() == 3 and m.columns[0] == "stat" and len(m.columns) == 10


def test_user_document_empty_user_has_no_row(spark, sf_small):
    posts = ForumTables(spark, sf_small).posts
    assert R.user_document(posts, -1).count() == 0


def test_dense_index_matches_global_row_number(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).cast("string").alias("term"))
    idx = R.dense_index(df, ["term"], "i", partitions=7)
    ref = df.withColumn("i", F.row_number().over(Window.orderBy("term")) - 1)
    assert idx.select("term", "i").exceptAll(ref.select("term", "i")).count() == 0


def test_dense_index_is_one_evaluation(spark, tmp_path):
    """Every position once on a written result of many rows, with the order kept."""
    df = spark.range(400_000).select(F.sha1(F.col("id").cast("string")).alias("term"))
    R.dense_index(df, ["term"], "i").write.parquet(f"{tmp_path}/i")
    got = spark.read.parquet(f"{tmp_path}/i")
    r = got.agg(F.countDistinct("i").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).first()
    assert (r.n, r.lo, r.hi) == (400_000, 0, 399_999)
    pairs = got.select(F.floor(F.col("i") / 1000).alias("b"), "term").groupBy("b").agg(
        F.min("term").alias("lo"), F.max("term").alias("hi")).orderBy("b").collect()
    assert all(a.hi < b.lo for a, b in zip(pairs, pairs[1:]))


def test_thread_user_documents_where_posts_stand(spark, monkeypatch):
    """lone posts are documents where they stand, whatever is null; the others are joined in order."""
    rows = [(1, 1, 1, "a"), (2, 1, 1, "b"), (0, 1, 1, None), (3, 1, 2, "c"), (4, 2, 2, None), (5, None, 2, "d"), (6, None, 2, "e"),
            (7, 2, None, "f"), (8, None, None, "g")]
    posts = spark.createDataFrame(rows, "post_id long, thread_id long, user_id long, post_text string").repartition(3)
    want = {(1, 1, "a b"), (1, 2, "c"), (2, 2, ""), (None, 2, "d e"), (2, None, "f"), (None, None, "g")}
    for most in (2_000_000, 0):
        monkeypatch.setattr(R, "MAX_PAIRS", most)
        got = R.thread_user_documents(posts)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    monkeypatch.setattr(R, "MAX_PAIRS", 2_000_000)
    alone = R.thread_user_documents(posts.where("post_id in (3, 4, 7)"))
    assert "collect_list" not in alone._jdf.queryExecution().optimizedPlan().toString()
