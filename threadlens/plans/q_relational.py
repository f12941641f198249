"""Projection/filter/join/aggregate/draw/set queries (P J A R U) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import relational as R
from threadlens.plans.oracle_sql import with_ctes
from threadlens.plans.registry import register
from threadlens.sources.forum import ForumTables

# Parameters of the registered queries (fixed values for the checks).
USER = 7
THREAD = 1000003
THREADS = [1000001, 1000002, 1000003]
AFTER = "2024-01-01 23:00:00"
PAGE = 2
FORUM = 44
FORUMS = [44, 45]
USER_MIN_POSTS = 60
THREAD_MIN_POSTS = 50
SEED = 42
STAT_USER = 7
KEYS = [f"k{i}" for i in range(9)]

# DuckDB version of the Python-whitespace tokenizer and URL-token filter.
SQL_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sql_clean_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SQL_SPACE}'), lambda x: x <> '' and not contains(x, 'http'))"


def sql_clean_post(text: str, min_words: int = 4) -> str:
    toks = sql_clean_tokens(text)
    return f"case when len({toks}) >= {min_words} then array_to_string({toks}, ' ') end"


def _t(spark, sf_dir) -> ForumTables:
    return ForumTables(spark, sf_dir)


# ---------------------------------------------------------------- P

@register("p1_user_posts", with_ctes(f"select post_id, post_text from posts where user_id = {USER}", "posts"))
def p1(spark, sf_dir):
    return R.user_post_texts(_t(spark, sf_dir).posts, USER)


@register("p2_thread_posts_after", with_ctes(
    f"select post_id, post_text from posts where thread_id = {THREAD} "
    f"and post_timestamp > timestamp '{AFTER}' and post_text is not null", "posts"))
def p2(spark, sf_dir):
    return R.thread_posts_after(_t(spark, sf_dir).posts, THREAD, AFTER)


@register("p3_posts_of_threads", with_ctes(
    "select post_id, thread_id from posts where thread_id in (select thread_id from topic_threads where key = 'k0')",
    "posts", "topic_threads"))
def p3(spark, sf_dir):
    t = _t(spark, sf_dir)
    ids = t.topic_threads.where(F.col("key") == "k0")
    return R.posts_of_threads(t.posts, ids).select("post_id", "thread_id")


@register("p4_post_clean_map", with_ctes(
    f"select post_id, {sql_clean_post('post_text')} as clean_text from posts "
    f"where thread_id in ({', '.join(map(str, THREADS))})", "posts"))
def p4(spark, sf_dir):
    return R.post_id_clean_map(_t(spark, sf_dir).posts, THREADS)


@register("p5_page_post_ids", with_ctes(
    f"select distinct post_id from posts where thread_id = {THREAD} and thread_page = {PAGE}", "posts"))
def p5(spark, sf_dir):
    return R.page_post_ids(_t(spark, sf_dir).posts, THREAD, PAGE)


@register("p6_forum_thread_ids", with_ctes(f"select distinct thread_id from threads where forum_id = {FORUM}", "threads"))
def p6(spark, sf_dir):
    return R.forum_thread_ids(_t(spark, sf_dir).threads, FORUM)


@register("p7_forum_threadlist", with_ctes(
    f"select distinct thread_id from threads where forum_id = {FORUM} and not is_ignored", "threads"))
def p7(spark, sf_dir):
    return R.forum_threadlist(_t(spark, sf_dir).threads, FORUM)


@register("p8_in_forums", with_ctes(
    "select thread_id, forum_id from threads where forum_id in (44, 46)", "threads"))
def p8(spark, sf_dir):
    return R.in_forums(_t(spark, sf_dir).threads, [44, 46]).select("thread_id", "forum_id")


@register("p9_in_threads", with_ctes(
    f"select post_id, thread_id from posts where thread_id in ({THREADS[0]}, {THREADS[1]})", "posts"))
def p9(spark, sf_dir):
    return R.in_threads(_t(spark, sf_dir).posts, THREADS[:2]).select("post_id", "thread_id")


@register("p10_thread_dataset", with_ctes(
    f"""select key, thread_id, post_id, clean_text from (
          select tt.key, p.thread_id, p.post_id,
                 array_to_string({sql_clean_tokens('p.post_text')}, ' ') as clean_text
          from posts p join topic_threads tt on tt.thread_id = p.thread_id
               join topic_release tr on tr.key = tt.key
          where p.post_timestamp >= cast(tr.release_date + interval 14 day as timestamp)) x
        where length(clean_text) >= 20""", "posts", "topic_threads", "topic_release"))
def p10(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.thread_dataset(t.posts, t.topic_threads, t.topic_release, 20, 14)


@register("p12_wordy_posts", with_ctes(
    r"select post_id from posts where regexp_matches(post_text, '[\p{L}\p{N}_]')", "posts"))
def p12(spark, sf_dir):
    return R.wordy_posts(_t(spark, sf_dir).posts).select("post_id")


# ---------------------------------------------------------------- J

@register("j1_last_page", with_ctes(
    "select p.thread_id, max(p.thread_page) as last_page from posts p join threads t on t.thread_id = p.thread_id "
    "where t.forum_id in (44, 45) group by p.thread_id", "posts", "threads"))
def j1(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.last_page_per_thread(t.posts, t.threads, FORUMS)


@register("j2_threads_minus_ignored", with_ctes(
    f"select distinct thread_id from threads where forum_id = {FORUM} "
    "and thread_id not in (select thread_id from thread_ignore where thread_id is not null)",
    "threads", "thread_ignore"))
def j2(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.forum_threads_minus_ignored(t.threads, t.thread_ignore, FORUM)


J3_SQL = with_ctes(
    f"""select coalesce(s.thread_id, l.thread_id) as thread_id,
               cast(case when l.thread_id is not null then greatest(coalesce(s.last_page, 1), 1)
                         else coalesce(s.last_page, 1) end as integer) as page
        from (select thread_id, max(thread_page) as last_page from posts where forum_id = {FORUM} group by thread_id) s
        full outer join (select distinct thread_id from threads where forum_id = {FORUM} and not is_ignored) l
          on l.thread_id = s.thread_id""", "posts", "threads")


@register("j3_crawl_frontier", J3_SQL)
def j3(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.crawl_frontier(t.posts, t.threads, FORUM)


@register("j4_new_threads", with_ctes(
    "select thread_id, thread_title from threads where thread_id not in (select thread_id from posts)",
    "posts", "threads"))
def j4(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.new_threads(t.threads.select("thread_id", "thread_title"), t.posts)


@register("j5_restart_pages", with_ctes(
    """select r.thread_id, cast(coalesce(a.max_page, 1) as integer) as page, a.stored_forum as forum_id,
              a.stored_forum is not null as forum_known
       from (select thread_id from threads) r
       left join (select thread_id, max(thread_page) as max_page, min(forum_id) as stored_forum
                  from posts group by thread_id) a on a.thread_id = r.thread_id""", "posts", "threads"))
def j5(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.restart_pages(t.threads.select("thread_id"), t.posts)


# ---------------------------------------------------------------- A

@register("a1_last_page_stored", with_ctes(
    f"select thread_id, max(thread_page) as last_page from posts where forum_id = {FORUM} group by thread_id", "posts"))
def a1(spark, sf_dir):
    return R.last_page_stored(_t(spark, sf_dir).posts, FORUM)


_KEYED = "from topic_threads tt left join posts p on p.thread_id = tt.thread_id group by tt.key"


@register("a2_post_count_by_key", with_ctes(f"select tt.key, count(p.post_id) as post_count {_KEYED}",
                                            "posts", "topic_threads"))
def a2(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.post_count_by_key(t.topic_threads, t.posts)


@register("a3_unique_posters_by_key", with_ctes(
    f"select tt.key, count(distinct p.user_id) as unique_posters {_KEYED}", "posts", "topic_threads"))
def a3(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.unique_posters_by_key(t.topic_threads, t.posts)


@register("a4_user_posts_by_key", with_ctes(
    f"select tt.key, count(*) filter (where p.user_id = {STAT_USER}) as user_posts {_KEYED}", "posts", "topic_threads"))
def a4(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.user_post_count_by_key(t.topic_threads, t.posts, STAT_USER)


@register("a5_user_document", with_ctes(
    f"select user_id, string_agg(post_text, ' ' order by post_id) as document from posts "
    f"where user_id = {USER} group by user_id", "posts"))
def a5(spark, sf_dir):
    return R.user_document(_t(spark, sf_dir).posts, USER)


@register("a6_thread_user_documents", with_ctes(
    "select thread_id, user_id, string_agg(post_text, ' ' order by post_id) as document from posts "
    "group by thread_id, user_id", "posts"))
def a6(spark, sf_dir):
    return R.thread_user_documents(_t(spark, sf_dir).posts)


@register("a7_corpus_length", with_ctes(
    "select sum(length(post_text)) + count(*) - 1 as total_chars from posts", "posts"))
def a7(spark, sf_dir):
    return R.corpus_joined_length(_t(spark, sf_dir).posts)


A8_SQL = with_ctes(
    "select stat, " + ", ".join(f"max(case when key = '{k}' then value end) as {k}" for k in KEYS) + f"""
     from (select key, 'post_count' as stat, count(p.post_id) as value {_KEYED}
           union all select key, 'unique_posters', count(distinct p.user_id) {_KEYED}
           union all select key, 'user_posts', count(*) filter (where p.user_id = {STAT_USER}) {_KEYED}) x
     group by stat""".replace("select key,", "select tt.key,"), "posts", "topic_threads")


@register("a8_stat_matrix", A8_SQL)
def a8(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.stat_matrix(t.topic_threads, t.posts, R.stat_registry(STAT_USER), KEYS)


@register("a12_users_over", with_ctes(
    f"select user_id, count(post_id) as post_count from posts group by user_id having count(post_id) > {USER_MIN_POSTS}",
    "posts"))
def a12u(spark, sf_dir):
    return R.groups_with_more_than(_t(spark, sf_dir).posts, "user_id", USER_MIN_POSTS)


@register("a12_threads_over", with_ctes(
    f"select thread_id, count(post_id) as post_count from posts group by thread_id "
    f"having count(post_id) > {THREAD_MIN_POSTS}", "posts"))
def a12t(spark, sf_dir):
    return R.groups_with_more_than(_t(spark, sf_dir).posts, "thread_id", THREAD_MIN_POSTS)


# ---------------------------------------------------------------- R

def _draw_sql(by: str, n: int, uniform: bool = False) -> str:
    h = f"md5('{SEED}:' || cast({by} as varchar))" if uniform else f"md5('{SEED}:' || cast(post_id as varchar))"
    return with_ctes(f"select {by} from posts group by {by} having count(post_id) > {n} "
                     f"order by min({h}), {by} limit 1", "posts")


@register("r1_random_user", _draw_sql("user_id", USER_MIN_POSTS))
def r1(spark, sf_dir):
    return R.random_user(_t(spark, sf_dir).posts, USER_MIN_POSTS, SEED)


@register("r1_random_user_uniform", _draw_sql("user_id", USER_MIN_POSTS, True))
def r1u(spark, sf_dir):
    return R.random_user(_t(spark, sf_dir).posts, USER_MIN_POSTS, SEED, uniform=True)


@register("r2_random_thread", _draw_sql("thread_id", THREAD_MIN_POSTS))
def r2(spark, sf_dir):
    return R.random_thread(_t(spark, sf_dir).posts, THREAD_MIN_POSTS, SEED)


@register("r3_random_thread_from_posts", with_ctes(
    f"select thread_id from posts order by md5('{SEED}:' || cast(post_id as varchar)), thread_id limit 1", "posts"))
def r3p(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.random_thread_id(t.posts, t.threads, True, SEED)


@register("r3_random_thread_listed", with_ctes(
    f"select thread_id from threads order by md5('{SEED}:' || cast(thread_id as varchar)), thread_id limit 1",
    "threads"))
def r3t(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.random_thread_id(t.posts, t.threads, False, SEED)


@register("r7_seeded_split", f"""
select doc_id, quality, case when rn <= floor(n / 2) then 'train' else 'test' end as split from (
  select doc_id, quality,
         row_number() over (partition by quality order by md5('{SEED}:' || cast(doc_id as varchar)), doc_id) as rn,
         count(*) over (partition by quality) as n
  from labels) x""")
def r7(spark, sf_dir):
    labels = _t(spark, sf_dir).raw("labels").select("doc_id", "quality")
    return R.seeded_split(labels, "doc_id", "quality", SEED)


# ---------------------------------------------------------------- U

@register("u1_union_posts", with_ctes(
    f"select post_id, thread_id from posts where thread_id = {THREADS[0]} union all "
    f"select post_id, thread_id from posts where thread_id = {THREADS[1]}", "posts"))
def u1(spark, sf_dir):
    posts = _t(spark, sf_dir).posts
    parts = [R.in_threads(posts, t).select("post_id", "thread_id") for t in THREADS[:2]]
    return parts[0].unionByName(parts[1])


@register("u2_union_thread_ids", with_ctes(
    "select thread_id from threads where forum_id = 44 union select thread_id from threads where forum_id = 45",
    "threads"))
def u2(spark, sf_dir):
    th = _t(spark, sf_dir).threads
    return R.union_thread_ids(R.forum_thread_ids(th, 44), R.forum_thread_ids(th, 45))


@register("u4_list_difference", with_ctes(
    "select thread_id, forum_id from threads where thread_id not in (select thread_id from thread_ignore)",
    "threads", "thread_ignore"))
def u4(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.list_difference(t.threads.select("thread_id", "forum_id"), t.thread_ignore, "thread_id")
