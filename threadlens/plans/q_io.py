"""Source and sink queries (S, K): the shaped rows each reader/writer produces, with DuckDB oracles.

Writers themselves are covered by round-trip tests; here the registered
queries check the rows they write.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.sources import io as IO
from threadlens.plans.oracle_sql import with_ctes
from threadlens.plans.registry import register
from threadlens.sources.forum import ForumTables
from threadlens.streaming.ingest import scratch

THREAD = 1000003
USER = 7
FORUM = 44
SAMPLE_N = 100
SAMPLE_SEED = 1


def _t(spark, sf_dir):
    return ForumTables(spark, sf_dir)


@register("s3_count_records", "select count(*) as n_records from documents")
def s3(spark, sf_dir):
    return IO.count_records(_t(spark, sf_dir).raw("documents"))


@register("s4_sql_params", with_ctes(
    f"select thread_id, count(*) as n_posts from posts where user_id = {USER} group by thread_id", "posts"))
def s4(spark, sf_dir):
    return IO.sql_query(spark, "SELECT thread_id, count(*) AS n_posts FROM {posts} WHERE user_id = :u GROUP BY thread_id",
                        args={"u": USER}, posts=_t(spark, sf_dir).posts)


@register("s5_single_value", with_ctes(f"select count(*) as n from posts where forum_id = {FORUM}", "posts"))
def s5(spark, sf_dir):
    return IO.sql_single_value(spark, "SELECT count(*) AS n FROM {posts} WHERE forum_id = :f",
                               args={"f": FORUM}, posts=_t(spark, sf_dir).posts)


@register("s5_first_column", with_ctes(
    f"select post_id from posts where forum_id = {FORUM} and thread_page = 1", "posts"))
def s5l(spark, sf_dir):
    return IO.sql_first_column(spark, "SELECT post_id, user_id FROM {posts} WHERE forum_id = :f AND thread_page = 1",
                               args={"f": FORUM}, posts=_t(spark, sf_dir).posts)


@register("s6_thread_posts", with_ctes(
    f"select post_id, user_id, thread_page from posts where thread_id = {THREAD}", "posts"))
def s6(spark, sf_dir):
    return IO.thread_posts(_t(spark, sf_dir).posts, THREAD).select("post_id", "user_id", "thread_page")


@register("s9_pages", "select page_id, url, length(html) as html_chars from pages")
def s9(spark, sf_dir):
    p = IO.read_pages(spark, f"{sf_dir}/pages.parquet")
    return p.select("page_id", "url", F.length("html").alias("html_chars"))


@register("s10_seeded_sample", f"select doc_id from documents order by md5('{SAMPLE_SEED}:' || cast(doc_id as varchar)), "
                               f"doc_id limit {SAMPLE_N}")
def s10(spark, sf_dir):
    return IO.seeded_sample(_t(spark, sf_dir).raw("documents").select("doc_id"), "doc_id", SAMPLE_N, SAMPLE_SEED)


_NL = "chr(10)"
_S11_SQL = f"""
with h as (select doc_id, case when instr(text, {_NL} || {_NL}) > 0
                               then substr(text, instr(text, {_NL} || {_NL}) + 2) else '' end as t from documents),
f as (select doc_id, t, string_split(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), {_NL}) as lines from h),
g as (select doc_id, t, lines,
             coalesce(list_max([i - 1 for i in range(1, len(lines) + 1) if regexp_matches(lines[i], '^\\s*-*\\s*$')]), 0) as idx
      from f),
k as (select doc_id, case when idx > 0 then array_to_string(lines[1:idx], {_NL}) else t end as t from g)
select doc_id, array_to_string(list_filter(string_split(t, {_NL}),
         lambda l: not regexp_matches(l, '(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\\||^>)')),
         {_NL}) as text_out
from k"""


@register("s11_strip_message", _S11_SQL)
def s11(spark, sf_dir):
    d = _t(spark, sf_dir).raw("documents").select("doc_id", "text")
    return IO.strip_message(d, "text", "text_out").select("doc_id", "text_out")


# ---------------------------------------------------------------- sinks

_POST_JSON_SQL = """to_json({'post_id': post_id, 'user_id': user_id, 'user_name': user_name, 'post_text': post_text,
  'thread_page': thread_page, 'post_date_timestamp': epoch_us(post_timestamp) // 1000,
  'quoted_post_ids': quoted_post_ids, 'thread_id': thread_id, 'forum_id': forum_id})"""


@register("k12_post_json", with_ctes(f"select post_id, {_POST_JSON_SQL} as json from posts", "posts"))
def k12p(spark, sf_dir):
    return IO.post_json(_t(spark, sf_dir).posts)


@register("k12_thread_json", with_ctes(
    "select thread_id, to_json({'thread_id': thread_id, 'thread_title': thread_title, 'forum_id': forum_id, "
    "'author': author, 'author_id': author_id, 'ignore': is_ignored}) as json from threads", "threads"))
def k12t(spark, sf_dir):
    return IO.thread_json(_t(spark, sf_dir).threads)


@register("k4_insert_or_ignore", with_ctes(
    "select distinct post_id from posts where thread_page >= 2 "
    "and post_id not in (select post_id from posts where thread_page < 3)", "posts"))
def k4(spark, sf_dir):
    p = _t(spark, sf_dir).posts
    existing = p.where(F.col("thread_page") < 3)
    new = p.where(F.col("thread_page") >= 2)
    return IO.insert_or_ignore(existing, new, "post_id").select("post_id")


_EDITED = """select post_id, user_id, user_name || '_edited' as user_name, post_text, thread_page,
                    post_timestamp + interval 1 hour as post_timestamp, thread_id, forum_id, quoted_post_ids
             from posts where thread_page = 1"""


@register("k5_dedupe_latest", with_ctes(
    f"""select post_id, arg_max(user_name, post_timestamp) as user_name, epoch_us(max(post_timestamp)) // 1000 as ts_ms
        from (select post_id, user_name, post_timestamp from posts union all
              select post_id, user_name, post_timestamp from ({_EDITED}) e) x group by post_id""", "posts"))
def k5(spark, sf_dir):
    p = _t(spark, sf_dir).posts
    edited = (p.where(F.col("thread_page") == 1)
              .withColumn("user_name", F.concat("user_name", F.lit("_edited")))
              .withColumn("post_timestamp", F.col("post_timestamp") + F.expr("INTERVAL 1 HOUR")))
    d = IO.dedupe_latest(p.unionByName(edited), "post_id", columns=["post_id", "user_name", "post_timestamp"])
    return d.select("post_id", "user_name", F.unix_millis("post_timestamp").alias("ts_ms"))


@register("k6_csv_rows", with_ctes(
    "select post_id, thread_id, user_name, user_id, replace(post_text, chr(10), '') as post_text, thread_page, "
    "strftime(post_timestamp, '%Y-%m-%d %H:%M:%S') as post_timestamp from posts", "posts"))
def k6(spark, sf_dir):
    return IO.csv_rows(_t(spark, sf_dir).posts, trim_newlines=True)


@register("k7_post_id_lines", with_ctes(f"select cast(post_id as varchar) as value from posts where thread_id = {THREAD}",
                                        "posts"))
def k7(spark, sf_dir):
    p = _t(spark, sf_dir).posts
    return p.where(F.col("thread_id") == THREAD).select(F.col("post_id").cast("string").alias("value"))


_POST_BODY_SQL = """to_json({'post_id': post_id, 'thread_id': thread_id, 'user_name': user_name, 'user_id': user_id,
  'text': %s, 'page': thread_page, 'timestamp': strftime(post_timestamp, '%%Y-%%m-%%d %%H:%%M:%%S')})"""


@register("k8_thread_post_json", with_ctes(
    f"select thread_id, forum_id, post_id, {_POST_BODY_SQL % 'post_text'} as post_json from posts", "posts"))
def k8(spark, sf_dir):
    return IO.thread_post_json_rows(_t(spark, sf_dir).posts)


@register("k8_thread_json_sink", with_ctes(
    f"select thread_id, forum_id, post_id, {_POST_BODY_SQL % 'post_text'} as post_json from posts", "posts"))
def k8s(spark, sf_dir):
    """Written by thread bucket and read back."""
    path = scratch(spark, "thread-json")
    IO.write_thread_json(_t(spark, sf_dir).posts, path)
    return spark.read.schema("thread_id long, forum_id int, post_id long, post_json string").json(path).select(
        "thread_id", "forum_id", "post_id", "post_json")


@register("k8_thread_documents", with_ctes(
    f"""select thread_id, forum_id, '{{"thread_id":"' || thread_id || '","forum_id":"' || forum_id || '","posts":[' ||
        string_agg({_POST_BODY_SQL % 'post_text'}::varchar, ',' order by post_id) || ']}}' as document
        from posts group by thread_id, forum_id""", "posts"))
def k8d(spark, sf_dir):
    return IO.thread_document(_t(spark, sf_dir).posts)


@register("k9_index_documents", with_ctes(
    f"select cast(forum_id as varchar) || '-' || cast(thread_id as varchar) as index, post_id as id, "
    f"{_POST_BODY_SQL % 'post_text'} as body from posts", "posts"))
def k9(spark, sf_dir):
    return IO.index_documents(_t(spark, sf_dir).posts)


@register("k9_index_sink", with_ctes(
    f"select cast(forum_id as varchar) || '-' || cast(thread_id as varchar) as index, post_id as id, "
    f"{_POST_BODY_SQL % 'post_text'} as body from posts", "posts"))
def k9s(spark, sf_dir):
    """Bulk files written by bucket of indexes and read back."""
    path = scratch(spark, "index")
    IO.write_index(_t(spark, sf_dir).posts, path)
    return spark.read.schema("index string, id long, body string").json(path).select("index", "id", "body")


_ASCII_TEXT = "regexp_replace(post_text, '[^\\x00-\\x7F]', '', 'g')"


@register("k9_index_documents_ascii", with_ctes(
    "select cast(forum_id as varchar) || '-' || cast(thread_id as varchar) || '-ascii' as index, post_id as id, "
    f"{_POST_BODY_SQL % _ASCII_TEXT} as body from posts", "posts"))
def k9a(spark, sf_dir):
    return IO.index_documents(_t(spark, sf_dir).posts, ascii_only=True)
