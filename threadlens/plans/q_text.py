"""Text, date, id and URL scalar queries (T1-T13, D1-D11) with DuckDB oracles.

They run over whole tables: ``documents`` texts, ``posts``, ``threads`` and
``pages``.  Inputs that the test tables do not hold in forum form (date cells,
post-id attributes, quote links, listing URLs) are rendered from the same rows
with the forum's formats and parsed back.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from threadlens.functions import ids as D
from threadlens.functions import text as T
from threadlens.operators import relational as R
from threadlens.plans.oracle_sql import with_ctes
from threadlens.plans.q_relational import FORUM, SQL_SPACE, sql_clean_post, sql_clean_tokens
from threadlens.plans.registry import register
from threadlens.sources.forum import ForumTables

STOP_WORDS = [w for w in (Path(__file__).resolve().parent.parent / "resources" / "stop_words_english.txt")
              .read_text().split("\n") if w]

SQL_WS = SQL_SPACE[:-1] + "{2,}|\\n|\\t"
SQL_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
SQL_WORDS = f"list_filter(regexp_split_to_array(text, '{SQL_SPACE}'), lambda x: x <> '')"


def _docs(spark, sf_dir):
    return ForumTables(spark, sf_dir).raw("documents").select("doc_id", "text")


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# ---------------------------------------------------------------- T1-T3, T11

@register("t1_collapse_whitespace", f"select doc_id, regexp_replace(text, '{SQL_WS}', ' ', 'g') as text_out from documents")
def t1(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.collapse_whitespace("text").alias("text_out"))


@register("t2_remove_emoji", f"select doc_id, regexp_replace(text, '{SQL_EMOJI}', '', 'g') as text_out from documents")
def t2(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.remove_emoji("text").alias("text_out"))


@register("t3_strip_non_ascii", r"select doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') as text_out from documents")
def t3(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.strip_non_ascii("text").alias("text_out"))


@register("t11_remove_newlines", "select doc_id, replace(text, chr(10), '') as text_out from documents")
def t11(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.remove_newlines("text").alias("text_out"))


# ---------------------------------------------------------------- T4-T9

@register("t4_drop_url_tokens", f"""
select page_id, array_to_string({sql_clean_tokens("url || ' ' || html")}, ' ') as text_out from pages""")
def t4(spark, sf_dir):
    pages = ForumTables(spark, sf_dir).raw("pages")
    toks = T.drop_url_tokens(T.as_words(F.concat_ws(" ", "url", "html")))
    return pages.select("page_id", F.array_join(toks, " ").alias("text_out"))


@register("t5_clean_post", with_ctes(f"select post_id, {sql_clean_post('post_text')} as clean_text from posts", "posts"))
def t5(spark, sf_dir):
    return ForumTables(spark, sf_dir).posts.select("post_id", T.clean_post("post_text", 4).alias("clean_text"))


@register("t6_clean_posts", f"""
select doc_id, clean_text from (select doc_id, {sql_clean_post('text', 8)} as clean_text from documents) x
where clean_text is not null""")
def t6(spark, sf_dir):
    return T.clean_posts(_docs(spark, sf_dir), "text", 8).select("doc_id", "clean_text")


@register("t7_as_words", f"select doc_id, len({SQL_WORDS}) as n_words, array_to_string({SQL_WORDS}, ' ') as sentence from documents")
def t7(spark, sf_dir):
    w = T.as_words("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(w).alias("n_words"), T.as_sentence(w).alias("sentence"))


_TOKS = f"""toks as (select doc_id, i - 1 as pos, t[i] as token
           from (select doc_id, t, generate_subscripts(t, 1) as i
                 from (select doc_id, {SQL_WORDS} as t from documents) a) b)"""


@register("t9_flatten_tokens", f"with {_TOKS} select doc_id, pos, token from toks")
def t9(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.as_words("text").alias("tokens"))
    return T.flatten_tokens(d, "tokens", "token")


NEG_SQL = "(" + " or ".join([f"lower(token) in ({', '.join(repr(n) for n in T.NEGATORS)})",
                              "ends_with(lower(token), 'n''t')"]) + ")"


@register("t10_mark_negation", f"""
with {_TOKS},
flags as (select *, {NEG_SQL} as neg, regexp_matches(token, '^.*[.:;!?]$') as en from toks),
w as (select *, max(case when neg then pos end) over (partition by doc_id order by pos
                                                     rows between unbounded preceding and 1 preceding) as ln,
                max(case when en then pos end) over (partition by doc_id order by pos
                                                     rows between unbounded preceding and 1 preceding) as le
      from flags)
select doc_id, pos, case when ln is not null and (le is null or le < ln) and not neg then token || '_NEG'
                    else token end as token
from w""")
def t10(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.as_words("text").alias("tokens"))
    return T.mark_negation_rows(d, "doc_id", "tokens", "token")


@register("t12_terms", "select doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), "
                       f"lambda x: not list_contains({_sql_list(STOP_WORDS)}, x)), ' ') as terms from documents")
def t12(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.terms("text", STOP_WORDS), " ").alias("terms"))


@register("t13_comma_ids", with_ctes(
    "select forum_id, string_agg(cast(thread_id as varchar), ',' order by thread_id) as thread_ids "
    "from threads group by forum_id", "threads"))
def t13(spark, sf_dir):
    th = ForumTables(spark, sf_dir).threads
    return th.groupBy("forum_id").agg(T.comma_join("thread_id").alias("thread_ids"))


# ---------------------------------------------------------------- D1-D4

# Forum date cell rendered from the post time: padded, blank for 'error' events.
def _date_cells(spark, sf_dir):
    ev = ForumTables(spark, sf_dir).raw("events")
    cell = F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(
        F.concat(F.lit(" "), F.date_format(F.col("ts").cast("timestamp"), "MMM d, yyyy HH:mm"), F.lit(" ")))
    return ev.select(F.col("event_id").alias("post_id"), cell.alias("date_cell"))


_DATE_CELLS_SQL = """cells as (select event_id as post_id,
    case when event_type = 'error' then '  ' else ' ' || strftime(ts, '%b %-d, %Y %H:%M') || ' ' end as date_cell
    from events)"""


@register("d1_parse_dates", f"""with {_DATE_CELLS_SQL}
select post_id, epoch_ms(try_strptime(trim(date_cell), '%b %d, %Y %H:%M')) as ts_ms from cells where trim(date_cell) <> ''""")
def d1(spark, sf_dir):
    c = D.clean_dates(_date_cells(spark, sf_dir), "date_cell", "ts")
    return c.select("post_id", D.epoch_millis("ts").alias("ts_ms"))


@register("d2_epoch_ms", with_ctes("select post_id, epoch_us(post_timestamp) // 1000 as ts_ms from posts", "posts"))
def d2(spark, sf_dir):
    return ForumTables(spark, sf_dir).posts.select("post_id", D.epoch_millis("post_timestamp").alias("ts_ms"))


@register("d3_parse_sql_ts", "select event_id, epoch_ms(try_strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), "
                             "'%Y-%m-%d %H:%M:%S')) as ts_ms from events")
def d3(spark, sf_dir):
    ev = ForumTables(spark, sf_dir).raw("events")
    s = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return ev.select("event_id", D.epoch_millis(D.parse_sql_timestamp(s)).alias("ts_ms"))


@register("d4_release_cutoff", with_ctes(
    "select thread_id, key, cast(release_date + interval 14 day as date) as cutoff from topic_threads "
    "join topic_release using (key)", "posts", "topic_threads", "topic_release"))
def d4(spark, sf_dir):
    t = ForumTables(spark, sf_dir)
    rel = t.topic_threads.join(t.topic_release, "key")
    return rel.select("thread_id", "key", D.release_cutoff("release_date").alias("cutoff"))


# ---------------------------------------------------------------- D5-D11

def _listing_url(forum):
    return F.concat(F.lit(D.DEFAULT_BASE_URL + "/forumdisplay.php?forumid="), forum.cast("string"),
                    F.lit("&perpage=40"))


@register("d5_forum_id_from_url", with_ctes(f"""
select 'thread' as src, thread_id as id,
       try_cast(nullif(regexp_extract(regexp_extract(url, '\\?([^#]*)', 1), '(?:^|&)forumid=(\\d{{2,}})', 1), '') as integer) as forum_id
from (select thread_id, '{D.DEFAULT_BASE_URL}/forumdisplay.php?forumid=' || cast(forum_id as varchar) || '&perpage=40' as url from threads) t
union all
select 'page', page_id,
       try_cast(nullif(regexp_extract(regexp_extract(url, '\\?([^#]*)', 1), '(?:^|&)forumid=(\\d{{2,}})', 1), '') as integer)
from pages""", "threads"))
def d5(spark, sf_dir):
    t = ForumTables(spark, sf_dir)
    a = t.threads.select(F.lit("thread").alias("src"), F.col("thread_id").alias("id"),
                         D.forum_id_from_url(_listing_url(F.col("forum_id"))).alias("forum_id"))
    b = t.raw("pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                              D.forum_id_from_url("url").alias("forum_id"))
    return a.unionByName(b)


@register("d6_thread_id_attr", with_ctes(
    """select src, id, id as parsed from (select 'thread' as src, thread_id as id from threads
       union all select 'post', post_id * 10 + 10000000 from posts
       union all select 'user', 100000 + user_id from (select distinct user_id from posts) u) x""",
    "threads", "posts"))
def d6(spark, sf_dir):
    """Ids of six, seven and eight digits and more, in the markup's form."""
    t = ForumTables(spark, sf_dir)
    ids = (t.threads.select(F.lit("thread").alias("src"), F.col("thread_id").alias("id"))
           .unionByName(t.posts.select(F.lit("post").alias("src"), (F.col("post_id") * 10 + 10000000).alias("id")))
           .unionByName(t.posts.select("user_id").distinct().select(F.lit("user").alias("src"),
                                                                    (F.col("user_id") + 100000).alias("id"))))
    attr = F.concat(F.lit("thread"), F.col("id").cast("string"))
    return ids.select("src", "id", D.thread_id_from_attr(attr).alias("parsed"))


@register("d7_first_digits", "select page_id, try_cast(nullif(regexp_extract(url, '(\\d+)', 1), '') as bigint) as digits from pages")
def d7(spark, sf_dir):
    return ForumTables(spark, sf_dir).raw("pages").select("page_id", D.first_digits("url").alias("digits"))


@register("d8_post_id_attr", with_ctes(
    "select post_id, try_cast(nullif(regexp_extract(attr, '^post(\\d+)$', 1), '') as bigint) as parsed from "
    "(select post_id, case when thread_page = 3 then 'post' || cast(post_id as varchar) || 'x' "
    "else 'post' || cast(post_id as varchar) end as attr from posts) x", "posts"))
def d8(spark, sf_dir):
    p = ForumTables(spark, sf_dir).posts
    attr = F.when(F.col("thread_page") == 3, F.concat(F.lit("post"), F.col("post_id").cast("string"), F.lit("x"))) \
        .otherwise(F.concat(F.lit("post"), F.col("post_id").cast("string")))
    return p.select("post_id", D.post_id_from_attr(attr).alias("parsed"))


@register("d9_quoted_post_id", with_ctes(
    "select post_id, try_cast(nullif(regexp_extract(links, '^(.*showthread\\.php\\?goto=post&amp;postid=)(\\d+)', 2), '') "
    "as bigint) as quoted from (select post_id, array_to_string(list_transform(quoted_post_ids, lambda q: "
    "'<a href=\"showthread.php?goto=post&amp;postid=' || cast(q as varchar) || '\">'), ' ') as links from posts) x",
    "posts"))
def d9(spark, sf_dir):
    p = ForumTables(spark, sf_dir).posts
    links = F.array_join(F.transform("quoted_post_ids", lambda q: F.concat(
        F.lit('<a href="showthread.php?goto=post&amp;postid='), q.cast("string"), F.lit('">'))), " ")
    return p.select("post_id", D.quoted_post_id(links).alias("quoted"))


@register("d10_normalize_page", with_ctes(
    "select post_id, case when thread_page - 2 < 0 then 1 else thread_page - 2 end as page from posts", "posts"))
def d10(spark, sf_dir):
    p = ForumTables(spark, sf_dir).posts
    return p.select("post_id", D.normalize_page(F.col("thread_page") - 2).alias("page"))


@register("d11_thread_urls", with_ctes(
    f"""select thread_id, '{D.DEFAULT_BASE_URL}/showthread.php?threadid=' || cast(thread_id as varchar)
               || '&userid=0&perpage=40&pagenumber=' || cast(page as varchar) as url
        from (select coalesce(s.thread_id, l.thread_id) as thread_id,
                     cast(case when l.thread_id is not null then greatest(coalesce(s.last_page, 1), 1)
                               else coalesce(s.last_page, 1) end as integer) as page
              from (select thread_id, max(thread_page) as last_page from posts where forum_id = {FORUM} group by thread_id) s
              full outer join (select distinct thread_id from threads where forum_id = {FORUM} and not is_ignored) l
                on l.thread_id = s.thread_id) f""", "posts", "threads"))
def d11(spark, sf_dir):
    t = ForumTables(spark, sf_dir)
    fr = R.crawl_frontier(t.posts, t.threads, FORUM)
    return fr.select("thread_id", D.thread_url("thread_id", "page").alias("url"))
