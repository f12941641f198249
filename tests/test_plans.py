"""Scale guards on physical plans: no cross products, filters reach the parquet scan."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from threadlens.sources import io as IO
from threadlens.sources.forum import ForumTables

NO_PAIRS = ["j6_quote_edges", "g3_degree", "g8_thread_graph", "a14_most_quoted", "a8_stat_matrix", "j3_crawl_frontier",
            "m1_tfidf", "m11_similar_documents", "m10_naive_bayes", "m6_silhouette", "m9_polarity", "r5_rank_polarity",
            "r7_seeded_split", "k5_dedupe_latest", "h4_posts_from_pages"]


def plan(spark, sf, name):
    df = E.queries()[name](spark, sf)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_cross_products(spark, sf_small, name):
    txt = plan(spark, sf_small, name)
    assert "CartesianProduct" not in txt and "BroadcastNestedLoopJoin" not in txt


def test_similar_documents_exchange_queries_not_pairs(spark, sf_small):
    """No exchange is dealt by (query, document); the last one, by query, follows the tasks' best rows."""
    txt = plan(spark, sf_small, "m11_similar_documents")
    dealt = [x for x in txt.splitlines() if x.strip().startswith("Arguments: hashpartitioning(")]
    assert dealt and not any("item_id" in x and "doc_id" in x for x in dealt)
    last = [x for x in dealt if "hashpartitioning(q" in x]
    assert len(last) == 1 and "MapInArrow" in txt


@pytest.fixture(scope="module")
def stored_posts(spark, sf_small, tmp_path_factory):
    """Posts written by K1: the filters of the readers reach the scan of stored posts."""
    path = str(tmp_path_factory.mktemp("stored") / "posts")
    IO.write_posts(ForumTables(spark, sf_small).posts, path, max_records=1000)
    return IO.read_posts(spark, path)


def explained(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("column, value", [("user_id", 7), ("thread_id", 1000003), ("forum_id", 2)])
def test_filters_pushed_to_stored_posts(stored_posts, column, value):
    txt = explained(stored_posts.where(f"{column} = {value}").select("post_id", column))
    lines = [x.strip() for x in txt.splitlines()]
    if column == "forum_id":        # a folder of the store: whole partitions are left out
        assert any(x.startswith("PartitionFilters:") and f"= {value})" in x for x in lines)
    else:
        assert any(x.startswith("PushedFilters:") and f"EqualTo({column},{value})" in x for x in lines)
    schema = next(x for x in txt.splitlines() if x.strip().startswith("ReadSchema:"))
    assert "post_text" not in schema


def test_thread_dataset_texts_are_not_dealt_by_thread(spark):
    """the threads' dates go to the posts, whatever the threshold of the session."""
    import datetime

    from threadlens.operators import relational as R

    old, new = datetime.datetime(2024, 1, 3), datetime.datetime(2024, 3, 1)
    posts = spark.createDataFrame([(1, 7, new, "long enough a text, surely"), (2, 7, old, "long enough a text, surely"),
                                   (3, 8, new, "short"), (4, 9, new, "long enough, but of no topic")],
                                  "post_id long, thread_id long, post_timestamp timestamp, post_text string")
    topics = spark.createDataFrame([("a", 7), ("b", 7), ("a", 8)], "key string, thread_id long")
    release = spark.createDataFrame([("a", datetime.date(2024, 1, 2)), ("b", datetime.date(2024, 6, 1))], "key string, release_date date")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = R.thread_dataset(posts, topics, release)
        assert "hashpartitioning(thread_id" not in out._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r)[:3] for r in out.collect()] == [("a", 7, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
