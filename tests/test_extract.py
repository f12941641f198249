from threadlens.operators import extract as H

PAGE = """<html><body><div id="thread" class="thread1000003">
<select><option value="1">1</option><option selected="selected" value="-2">2</option></select>
<div class="bbc-block"><a href="showthread.php?goto=post&amp;postid=1">orphan quote before any post</a></div>
<table id="post345"><tr><td><dl class="userinfo"><dt>user7</dt></dl>
<ul class="profilelinks"><li><a href="member.php?userid=7">p</a></li><li><a href="search.php?userid=7">h</a></li></ul></td>
<td class="postbody"><div class="bbc-block"><a href="showthread.php?goto=post&amp;postid=301#post301">q</a>quoted words
<div class="bbc-block"><a href="showthread.php?goto=post&amp;postid=299">inner</a></div></div>
 post   text &amp; more <p class="editedby">edited</p></td>
<td class="postdate"> Jan 3, 2024 10:15 </td></tr></table>
<table id="post346"><tr><td><dl class="userinfo"><dt>user8</dt></dl>
<ul class="profilelinks"><li><a href="member.php?userid=8">p</a></li><li><a href="search.php?userid=8">h</a></li></ul></td>
<td class="postbody">second<br>post</td></tr></table>
</div></body></html>"""

LISTING = """<html><body><table><tbody>
<tr class="thread" id="thread1000003"><td><a class="thread_title">Title A</a></td>
<td class="author"><a href="member.php?userid=7">user7</a></td><td class="replies">12</td><td class="views">-</td></tr>
<tr class="thread" id="thread1000004"><td></td>
<td class="author"><a href="member.php?userid=8">user8</a></td><td class="replies">3</td><td class="views">40</td></tr>
</tbody></table></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_post_page_edges(spark):
    df = pages(spark, [(1, "https://f.invalid/showthread.php?threadid=1000003&forumid=44", PAGE)])
    rows = sorted(H.posts_from_pages(df).collect(), key=lambda r: r.post_id)
    assert [r.post_id for r in rows] == [345, 346]
    a, b = rows
    assert a.thread_id == 1000003 and a.thread_page == 1 and a.forum_id == 44  # negative page -> 1
    assert a.user_id == 7 and a.user_name == "user7"
    assert a.post_text == " post text & more "
    assert a.quoted_post_ids == [301, 299]  # orphan quote before any post dropped
    assert str(a.post_timestamp) == "2024-01-03 10:15:00"
    assert b.post_timestamp is None and b.post_text == "secondpost"  # missing date cell -> NULL, no shift
    nxt = H.next_pages(df).first()
    assert nxt.next_page is None  # last page: no next link


def test_listing_and_quality(spark):
    df = pages(spark, [(1, "https://f.invalid/forumdisplay.php?forumid=44&pagenumber=1", LISTING),
                       (2, "https://f.invalid/forumdisplay.php?forumid=5", LISTING)])
    rows = sorted(H.threads_from_listing(df, with_counts=True).collect(), key=lambda r: (r.forum_id or 0, r.thread_id))
    assert {(r.forum_id, r.thread_id) for r in rows} == {(44, 1000003), (44, 1000004), (None, 1000003), (None, 1000004)}
    r = [x for x in rows if x.thread_id == 1000004][0]
    assert r.thread_title is None and r.author_id == 8 and r.views == "40"
    q = H.listing_quality(df).collect()
    assert len(q) == 2 and q[0].n_titles == 1 and q[0].n_ids == 2


def test_visible_text_and_fields(spark):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav>"
            "<script>var x='<p>'</script><h1>Head</h1><p>Hello  <b>world</b></p><a href=\"/x\">l</a></body></html>")
    df = pages(spark, [(1, "http://h.example.com/a?b=1#c", html)])
    assert H.visible_text(df).first().visible_text == "HeadHello worldl"
    f = H.page_fields(df).first()
    assert (f.title, f.heading, f.n_links, f.host, f.query) == ("T", "Head", 1, "h.example.com", "b=1")


def test_latin1_fallback(spark):
    df = pages(spark, [(1, "u", "ab€cé")])
    assert H.latin1_fallback(df).first().html_latin1 == "abcé"


def test_plain_pages_give_the_events_of_the_tokenizer():
    """Pages of plain tags are split at their tags, with the same calls as the tokenizer's; others are left to it."""
    import random

    from threadlens.operators import extract as E

    class Log(E._Tree):
        def __init__(self):
            super().__init__()
            self.log = []

        def on_start(self, tag, attrs, classes):
            self.log.append(("start", tag, attrs, classes, len(self.stack)))

        def on_end(self, tag, el):
            self.log.append(("end", tag, el))

        def handle_data(self, data):
            self.log.append(("data", data))

    pieces = ["<tr>", "</tr>", '<TD class="a B">', "</td>", '<a href="x?a=1&amp;b=2" title="Next page">', "</a>", "<br>", "text",
              "a &amp; b &lt;c&gt; &copy &#65;", "\n", "<title>", "</title>", "</p>", '<p id="">', "\x1c\u2028", "&", "&am"]
    odd = ["<!-- x <b> -->", "a < b", "<br/>", "<p id=x>", "<script>", "</script>", '<a href="a&copy=1">', "<input checked>",
           '<a title="x > y">', "<p\nid='z'>", "<", "</ p>", "<!doctype html>", "<![CDATA[x]]>", "</>", "<?pi?>"]
    rng = random.Random(5)
    plain = 0
    for i in range(3000):
        html = "".join(rng.choice(pieces + (odd if i % 3 == 0 else [])) for _ in range(rng.randrange(14)))
        slow, fast = Log(), Log()
        slow.feed(html)
        slow.close()
        got, _ = E._feed(fast, html)
        assert got.log == slow.log and got.stack == slow.stack, html
        plain += Log().feed_plain(html)
    assert plain > 1000


def test_page_texts_are_dealt_once(spark):
    """No list of texts below a shuffle and no finished page above it; every post on its page, in order."""
    import datetime

    from threadlens.sources import forum as FO

    rows = [(p, 1, "u", f"text {p}", 1 + p % 3, datetime.datetime(2024, 1, 1), t, 44, [])
            for t in (5, 6, None) for p in range(9)]
    posts = spark.createDataFrame(rows, "post_id long, user_id long, user_name string, post_text string, thread_page int, "
                                        "post_timestamp timestamp, thread_id long, forum_id int, quoted_post_ids array<long>")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    few = FO.PAGE_POSTS
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        FO.PAGE_POSTS = 1
        pages = FO.render_thread_pages(posts)
        plan = pages._jdf.queryExecution().executedPlan().toString()
        assert plan.rindex("collect_list") < plan.index("Exchange")
        n = max(27, spark.sparkContext.defaultParallelism)
        assert f", {n}), REPARTITION_BY_NUM" in plan     # a task a post
        got = {r["page_id"]: r["html"] for r in pages.collect()}
    finally:
        FO.PAGE_POSTS = few
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    assert sorted(got) == [t * 1000 + p for t in (5, 6) for p in (1, 2, 3)]
    for page_id, html in got.items():
        at = [html.find(f"text {p}<") for p in range(9) if 1 + p % 3 == page_id % 1000]
        assert at == sorted(at) and at[0] > 0
        assert ("Next page" in html) == (page_id % 1000 < 3)
