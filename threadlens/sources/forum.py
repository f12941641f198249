"""Forum tables derived from the driver's parquet tables.

The reference stores scraped ``posts`` and ``threads``; the test data ships
generic tables instead (``events``, ``documents``, ``pages``).  These builders
shape them into the forum schema with plain DataFrame code, so every query's
work grows with the input tables.  The same rules are written as DuckDB CTEs in
``threadlens.plans.oracle_sql`` for the correctness oracle.

Rules (fixed values):
  post_id        = event_id
  user_name      = 'user' || user_id % 140   (ids 0-9 and 140-149 share a name)
  post_text      = the whole text of document  event_id % (number of documents)
  thread_page    = 1 + (event_id % 100) div 40
  thread_id      = 1000000 + event_id div 100
  forum_id       = 44 + (event_id div 100) % 4
  quoted_post_ids: k = props.k; [event_id - k] when 1 <= k <= event_id, purchases
                   with k >= 2 also quote event_id - k div 2; else empty
  threads        = posted blocks with blk % 11 <> 0 (the rest stay unlisted)
                   plus one listed thread per page (2000000 + page_id)
  thread_ignore  = blocks with blk % 13 = 0
  topic key      = 'k' || (thread_id - 1000000) % 9, release 2024-01-02 + key number days
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import cut_lineage, deal, slices


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts_from_events(events: DataFrame, documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.col("text").alias("post_text"))
    # Number of documents as a scalar subquery: stays in the plan, no driver round trip.
    ndocs = documents.agg(F.count(F.lit(1))).scalar()
    e = events.select(
        "event_id", "user_id", "ts", "event_type",
        F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"),
    )
    eid = F.col("event_id")
    k = F.col("k")
    quotes = (F.when(k.between(F.lit(1), eid),
                     F.when((F.col("event_type") == "purchase") & (k >= 2),
                            F.array(eid - k, eid - F.expr("k div 2")))
                     .otherwise(F.array(eid - k)))
              .otherwise(F.array().cast("array<bigint>")))
    e = e.withColumn("doc_id", F.pmod(eid, ndocs))
    return (e.join(docs, "doc_id")
            .select(
                eid.alias("post_id"),
                F.col("user_id"),
                F.concat(F.lit("user"), (F.col("user_id") % 140).cast("string")).alias("user_name"),
                F.col("post_text"),
                (F.lit(1) + F.expr("(event_id % 100) div 40")).cast("int").alias("thread_page"),
                F.col("ts").cast("timestamp").alias("post_timestamp"),
                (F.lit(1000000) + F.expr("event_id div 100")).alias("thread_id"),
                (F.lit(44) + F.expr("(event_id div 100) % 4")).cast("int").alias("forum_id"),
                quotes.alias("quoted_post_ids"),
            ))


def threads_from(events: DataFrame, pages: DataFrame) -> DataFrame:
    blk = F.col("blk")
    posted = (events.select(F.expr("event_id div 100").alias("blk")).distinct()
              .where(blk % 11 != 0)
              .select((F.lit(1000000) + blk).alias("thread_id"),
                      F.concat(F.lit("Thread "), blk.cast("string")).alias("thread_title"),
                      (F.lit(44) + blk % 4).cast("int").alias("forum_id"),
                      F.concat(F.lit("user"), (blk % 140).cast("string")).alias("author"),
                      (blk % 150).alias("author_id"),
                      (blk % 7 == 0).alias("is_ignored")))
    pid = F.col("page_id")
    listed = pages.select(
        (F.lit(2000000) + pid).alias("thread_id"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("thread_title"),
        (F.lit(44) + pid % 4).cast("int").alias("forum_id"),
        F.concat(F.lit("user"), (pid % 140).cast("string")).alias("author"),
        (pid % 150).alias("author_id"),
        (pid % 5 == 0).alias("is_ignored"))
    return posted.unionByName(listed)


def thread_ignore_from(events: DataFrame) -> DataFrame:
    blk = F.expr("event_id div 100")
    return (events.select(blk.alias("blk")).where(F.col("blk") % 13 == 0).distinct()
            .select((F.lit(1000000) + F.col("blk")).alias("thread_id")))


def topic_key(thread_id: Column) -> Column:
    return F.concat(F.lit("k"), ((thread_id - F.lit(1000000)) % 9).cast("string"))


def topic_threads_from(posts: DataFrame) -> DataFrame:
    return posts.select(topic_key(F.col("thread_id")).alias("key"), "thread_id").distinct()


def topic_release_table(spark: SparkSession) -> DataFrame:
    """Nine topic keys with release dates (a fixed lookup, joined against posts)."""
    return spark.range(9).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
        F.date_add(F.lit("2024-01-02").cast("date"), F.col("id").cast("int")).alias("release_date"))


class ForumTables:
    """Lazily built forum tables for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def posts(self) -> DataFrame:
        return posts_from_events(self.raw("events"), self.raw("documents"))

    @cached_property
    def threads(self) -> DataFrame:
        return threads_from(self.raw("events"), self.raw("pages"))

    @cached_property
    def thread_ignore(self) -> DataFrame:
        return thread_ignore_from(self.raw("events"))

    @cached_property
    def topic_threads(self) -> DataFrame:
        return topic_threads_from(self.posts)

    @cached_property
    def topic_release(self) -> DataFrame:
        return topic_release_table(self.spark)

    @cached_property
    def thread_pages(self) -> DataFrame:
        return render_thread_pages(self.posts)

    @cached_property
    def thread_page_slices(self) -> list[DataFrame]:
        """``thread_pages`` in parts by thread, for jobs that are done part by part."""
        return [render_thread_pages(p) for p in slices(self.posts, "thread_id", self.raw("events").count())]

    @cached_property
    def listing_pages(self) -> DataFrame:
        return render_listing_pages(self.threads)


# ---------------------------------------------------------------- rendered forum pages (H fixtures)

def _esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


PAGE_POSTS = 16_384     # posts whose texts one task gathers into pages


# Forum markup of thread and listing pages (selectors the extractor reads).
BASE_URL = "https://forum.invalid"


def _post_html(post: Column) -> Column:
    """The markup of one post."""
    pid, uid = post["post_id"].cast("string"), post["user_id"].cast("string")
    quotes = F.array_join(F.transform(post["quoted_post_ids"], lambda q: F.concat(
        F.lit('<div class="bbc-block"><h4><a href="showthread.php?goto=post&amp;postid='), q.cast("string"),
        F.lit("#post"), q.cast("string"), F.lit('">quote</a></h4><blockquote>quoted words</blockquote></div>'))), "")
    return F.concat(
        F.lit('<table id="post'), pid, F.lit('"><tr><td class="userinfo"><dl class="userinfo"><dt>'),
        _esc(post["user_name"]),
        F.lit('</dt></dl><ul class="profilelinks"><li><a href="member.php?action=getinfo&amp;userid='), uid,
        F.lit('">Profile</a></li><li><a href="search.php?action=do_search_posthistory&amp;userid='), uid,
        F.lit('">Post History</a></li></ul></td><td class="postbody">'), quotes, _esc(post["post_text"]),
        F.lit('<p class="editedby">edited</p></td><td class="postdate"> '),
        F.date_format(post["post_timestamp"], "MMM d, yyyy HH:mm"), F.lit(" </td></tr></table>"))


def render_thread_pages(posts: DataFrame, base_url: str = BASE_URL) -> DataFrame:
    """One HTML page per (thread, page) in the forum's markup, rendered from posts.

    A page holds at most one page's posts (40), so each group is bounded.
    ``page_id = thread_id * 1000 + thread_page``.

    The posts are dealt by page once, without their markup, in tasks of ``PAGE_POSTS`` rows, and grouped where they lie: a
    partial list before the shuffle saves no byte and is sorted on disk. The last page of a thread comes as one more
    row of each of its pages, so that no finished page is shuffled to meet it.
    """
    keys = ["thread_id", "thread_page", "forum_id"]
    seen = cut_lineage(posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    marks = seen.join(seen.groupBy("thread_id").agg(F.max("thread_page").alias("last_page")), "thread_id")
    n_posts = seen.agg(F.sum("n")).first()[0] or 0
    post = F.struct("post_id", "user_id", "user_name", "quoted_post_ids", "post_text", "post_timestamp")
    rows = (posts.where("thread_id IS NOT NULL").select(*keys, post.alias("post"), F.lit(None).cast("int").alias("last_page"))
            .unionByName(marks.withColumn("post", F.lit(None)).select(*keys, "post", "last_page")))
    frags = F.array_sort(F.transform(F.collect_list("post"), lambda p: F.struct(p["post_id"].alias("post_id"), _post_html(p).alias("frag"))))
    pages = (deal(rows, keys, n_posts, PAGE_POSTS).groupBy(*keys)
             .agg(F.array_join(F.transform(frags, lambda s: s["frag"]), "\n").alias("body"),
                  F.max("last_page").alias("last_page")))
    tid = F.col("thread_id").cast("string")
    page = F.col("thread_page").cast("string")
    nxt = F.when(F.col("thread_page") < F.col("last_page"), F.concat(
        F.lit('<a title="Next page" href="showthread.php?threadid='), tid, F.lit("&amp;pagenumber="),
        (F.col("thread_page") + 1).cast("string"), F.lit('">next</a>'))).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><head><title>Thread "), tid, F.lit('</title></head><body><div id="thread" class="thread'),
                    tid, F.lit('"><select><option value="1">1</option><option selected="selected" value="'), page,
                    F.lit('">'), page, F.lit("</option></select>\n"), F.col("body"), F.lit("\n</div>"), nxt,
                    F.lit("</body></html>"))
    url = F.concat(F.lit(base_url + "/showthread.php?threadid="), tid, F.lit("&forumid="),
                   F.col("forum_id").cast("string"), F.lit("&userid=0&perpage=40&pagenumber="), page)
    return (pages
            .select((F.col("thread_id") * 1000 + F.col("thread_page")).alias("page_id"), url.alias("url"),
                    html.alias("html")))


def listing_views(threads: DataFrame) -> tuple[Column, Column]:
    """Views/replies cells of the listing: '-' for ignored (administrative) rows."""
    ign = F.col("is_ignored")
    views = F.when(ign, F.lit("-")).otherwise((F.col("author_id") * 7).cast("string"))
    replies = F.when(ign, F.lit("-")).otherwise((F.col("author_id") % 50).cast("string"))
    return views, replies


def render_listing_pages(threads: DataFrame, base_url: str = BASE_URL, per_page: int = 40) -> DataFrame:
    """Forum listing pages rendered from threads; page = thread_id div 40 inside a forum (bounded groups)."""
    tid = F.col("thread_id").cast("string")
    views, replies = listing_views(threads)
    row = F.concat(
        F.lit('<tr class="thread" id="thread'), tid,
        F.lit('"><td class="title"><a class="thread_title" href="showthread.php?threadid='), tid, F.lit('">'),
        _esc(F.col("thread_title")),
        F.lit('</a></td><td class="author"><a href="member.php?action=getinfo&amp;userid='),
        F.col("author_id").cast("string"), F.lit('">'), _esc(F.col("author")),
        F.lit('</a></td><td class="replies">'), replies, F.lit('</td><td class="views">'), views,
        F.lit("</td></tr>"))
    pages = (threads.select("forum_id", (F.col("thread_id") / per_page).cast("bigint").alias("blk"), "thread_id",
                            row.alias("row"))
             .groupBy("forum_id", "blk")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("thread_id", "row"))),
                                           lambda s: s["row"]), "\n").alias("rows")))
    html = F.concat(F.lit("<html><body><table><tbody>\n"), F.col("rows"), F.lit("\n</tbody></table></body></html>"))
    url = F.concat(F.lit(base_url + "/forumdisplay.php?forumid="), F.col("forum_id").cast("string"),
                   F.lit("&pagenumber="), F.col("blk").cast("string"))
    return pages.select((F.col("blk") * 100 + F.col("forum_id")).alias("page_id"), url.alias("url"), html.alias("html"))
