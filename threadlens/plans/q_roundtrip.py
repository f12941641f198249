"""Reader/writer round trips (S1, S2, S7, S8, K1, K2, K10, K11): write with the sink into the shared
checkpoint folder, read back with the source under its declared schema; the oracle is the table written."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.plans.oracle_sql import with_ctes
from threadlens.plans.q_relational import A8_SQL, KEYS, STAT_USER
from threadlens.plans.q_stats import M9_CTES, _polarities
from threadlens.plans.registry import register
from threadlens.operators import relational as R
from threadlens.sources import io as IO
from threadlens.sources import rolling as RO
from threadlens.sources.forum import ForumTables
from threadlens.streaming.ingest import scratch

MAX_RECORDS = 500


@register("k3_load_into_table", with_ctes("select thread_id, count(*) as n_posts from posts group by thread_id", "posts"))
def k3(spark, sf_dir):
    """Load into an existing table, twice by halves; the table then holds every post once."""
    import uuid

    posts = ForumTables(spark, sf_dir).posts.select("post_id", "thread_id", "user_id")
    table, path = f"posts_{uuid.uuid4().hex}", scratch(spark, "load-table")
    posts.limit(0).write.parquet(path)
    spark.sql(f"CREATE TABLE {table} (post_id BIGINT, thread_id BIGINT, user_id BIGINT) USING parquet LOCATION '{path}'")
    for part in (0, 1):
        IO.load_into_table(spark, posts.where(F.col("post_id") % 2 == part), table)
    loaded = spark.read.schema("post_id long, thread_id long, user_id long").parquet(path)
    spark.sql(f"DROP TABLE {table}")        # the files stay: the table is external
    return loaded.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n_posts"))


@register("s1_k1_posts_round_trip", with_ctes(
    "select post_id, thread_id, forum_id, thread_page, user_id, length(post_text) as text_chars, "
    "len(quoted_post_ids) as n_quotes from posts", "posts"))
def s1k1(spark, sf_dir):
    path = scratch(spark, "posts-store")
    IO.write_posts(ForumTables(spark, sf_dir).posts, path, max_records=MAX_RECORDS)
    p = IO.read_posts(spark, path)
    return p.select("post_id", "thread_id", "forum_id", "thread_page", "user_id",
                    F.length("post_text").alias("text_chars"), F.size("quoted_post_ids").alias("n_quotes"))


@register("k1_rolling_parts", with_ctes(
    "select post_id, thread_id, user_id, user_name, thread_page, post_text, len(quoted_post_ids) as n_quotes from posts", "posts"))
def k1r(spark, sf_dir):
    """Posts through a serializer into parts closed at a byte size, read back as JSON lines."""
    path = scratch(spark, "rolling")
    posts = ForumTables(spark, sf_dir).posts.select("post_id", "thread_id", "user_id", "user_name", "thread_page", "post_text",
                                                    F.size("quoted_post_ids").alias("n_quotes"))
    RO.write_rolling(posts, path)
    return spark.read.schema(posts.schema).json(path)


@register("s2_k2_threads_round_trip", with_ctes(
    "select thread_id, thread_title, forum_id, author, author_id, is_ignored from threads", "threads"))
def s2k2(spark, sf_dir):
    path = scratch(spark, "thread-store")
    IO.write_threads(ForumTables(spark, sf_dir).threads, path, max_records=MAX_RECORDS)
    return IO.read_threads(spark, path)


@register("k10_s8_polarity_csv", with_ctes("select thread, post_id, neg, neu, pos, compound from pol",
                                           "posts", "topic_threads", extra=M9_CTES))
def k10s8(spark, sf_dir):
    path = scratch(spark, "polarity-csv")
    IO.write_polarities(_polarities(spark, sf_dir), path, header=True)
    return IO.read_polarities(spark, path)


@register("k11_stat_matrix_csv", A8_SQL)
def k11(spark, sf_dir):
    t = ForumTables(spark, sf_dir)
    path = scratch(spark, "stat-matrix-csv")
    IO.write_frame_csv(R.stat_matrix(t.topic_threads, t.posts, R.stat_registry(STAT_USER), KEYS), path)
    schema = "stat string, " + ", ".join(f"{k} bigint" for k in KEYS)
    return spark.read.schema(schema).option("header", True).csv(path)


_ONE_LINE = "replace(replace(text, chr(10), ' '), chr(13), ' ')"


@register("s7_read_lines", f"select sha256({_ONE_LINE}) as doc_key, length({_ONE_LINE}) as n_chars from documents")
def s7(spark, sf_dir):
    path = scratch(spark, "lines")
    docs = ForumTables(spark, sf_dir).raw("documents")
    one_line = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    docs.select(one_line.alias("value")).write.text(path)
    lines = IO.read_lines(spark, path)
    return lines.select("doc_key", F.length("text").alias("n_chars"))
