"""Page extraction (H1-H9): raw HTML pages -> typed rows.

Spark has no HTML parser (``xpath`` needs well-formed XML), so one
``mapInPandas`` pass per page table runs Python's standard ``html.parser``
(pages of plain tags only are split at their tags instead, with the same events)
and emits raw strings per element of interest.  Everything after it (ids,
dates, whitespace, quote maps, joins) is Column code on the JVM side.

Each post table and each listing row is parsed on its own, so a missing
field becomes NULL instead of shifting the following rows.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import ids as D
from threadlens.functions import text as T

VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
             "track", "wbr", "option"}


# Tags in their plain form, which need no tokenizer: attributes in double quotes, one space between them.
_PLAIN_TAG = re.compile(r'(<(?:/[a-zA-Z][a-zA-Z0-9]*|[a-zA-Z][a-zA-Z0-9]*(?: [a-zA-Z][a-zA-Z0-9-]*="[^"<>]*")*)>)')
_PLAIN_ATTR = re.compile(r' ([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
# Elements whose content the tokenizer does not read as markup.
_RAW_TAGS = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}
_TAG_CACHE: dict[str, tuple[str, dict | None, set]] = {}
_TAG_CACHE_SIZE = 1024


def _plain_tag(said: str) -> tuple[str, dict | None, set] | None:
    """Name, attributes (None: an end tag) and classes of a plain tag; None if a value has an entity beside ``&amp;``."""
    if said[1] == "/":
        tag = (said[2:-1].lower(), None, set())
    else:
        attrs = {}
        for name, value in _PLAIN_ATTR.findall(said):
            if "&" in value:
                if value.count("&") != value.count("&amp;"):
                    return None
                value = value.replace("&amp;", "&")
            attrs[name.lower()] = value
        tag = (said[1:-1].split(" ", 1)[0].lower(), attrs, set((attrs.get("class") or "").split()))
    if len(_TAG_CACHE) < _TAG_CACHE_SIZE:
        _TAG_CACHE[said] = tag
    return tag


class _Tree(HTMLParser):
    """Minimal element stack: tracks open tags with their classes/ids; tolerant of unclosed tags."""

    def feed_plain(self, html: str) -> bool:
        """Reads a page whose every ``<`` opens a plain tag, with the calls that ``feed`` and ``close`` would make.

        Any other page is left alone (False): nothing has been called.
        """
        parts = _PLAIN_TAG.split(html)
        if len(parts) // 2 != html.count("<"):
            return False
        tags = [_TAG_CACHE.get(said) or _plain_tag(said) for said in parts[1::2]]
        raw = None
        for tag in tags:
            if tag is None or (raw is not None and (tag[1] is not None or tag[0] != raw)):
                return False
            raw = tag[0] if tag[1] is not None and tag[0] in _RAW_TAGS else None
        if raw is not None:
            return False
        for data, (name, attrs, classes) in zip(parts[::2], tags):
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
            if attrs is None:
                self.handle_endtag(name)
            else:
                if name not in VOID_TAGS:
                    self.stack.append((name, classes, attrs.get("id")))
                self.on_start(name, attrs, classes)
        if parts[-1]:
            self.handle_data(unescape(parts[-1]))
        return True

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, set, str | None]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        if tag not in VOID_TAGS:
            self.stack.append((tag, classes, a.get("id")))
        self.on_start(tag, a, classes)

    def handle_startendtag(self, tag, attrs):
        a = dict(attrs)
        self.on_start(tag, a, set((a.get("class") or "").split()))
        if tag not in VOID_TAGS:
            self.on_end(tag, (tag, set((a.get("class") or "").split()), a.get("id")))

    def handle_endtag(self, tag):
        if self.stack and self.stack[-1][0] == tag:
            self.on_end(tag, self.stack.pop())
            return
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            el = self.stack.pop()
            self.on_end(el[0], el)
            if el[0] == tag:
                break

    def inside(self, tag=None, cls=None, id_=None) -> bool:
        for t, c, i in self.stack:
            if (tag is None or t == tag) and (cls is None or cls in c) and (id_ is None or i == id_):
                return True
        return False

    def on_start(self, tag, attrs, classes):
        pass

    def on_end(self, tag, el):
        pass


class PostPageParser(_Tree):
    """Thread page: page-level fields plus one record per post table (H4-H7)."""

    def __init__(self):
        super().__init__()
        self.thread_attr = None
        self.page_value = None
        self.next_href = None
        self.posts: list[dict] = []
        self.cur: dict | None = None
        self.orphan_quotes = 0
        self._quote: dict | None = None

    def on_start(self, tag, a, classes):
        if tag == "div" and a.get("id") == "thread" and self.thread_attr is None:
            self.thread_attr = a.get("class")
        elif tag == "option" and "selected" in a and self.page_value is None:
            self.page_value = a.get("value")
        elif tag == "a" and a.get("title") == "Next page":
            self.next_href = a.get("href")
        elif tag == "table" and a.get("id") and self.inside("div", id_="thread"):
            self.cur = {"post_attr": a.get("id"), "user": None, "links": [], "date": None, "body": [],
                        "quotes": []}
            self.posts.append(self.cur)
        if self.cur is None:
            if tag == "div" and "bbc-block" in classes:
                self.orphan_quotes += 1
            return
        if tag == "a" and self.inside("ul", cls="profilelinks") and a.get("href"):
            self.cur["links"].append(a.get("href"))
        if tag == "div" and "bbc-block" in classes:
            self._quote = {"href": None}
            self.cur["quotes"].append(self._quote)
        if tag == "a" and self._quote is not None and self._quote["href"] is None and a.get("href"):
            self._quote["href"] = a.get("href")

    def on_end(self, tag, el):
        if tag == "div" and "bbc-block" in el[1]:
            self._quote = None
        if tag == "table" and self.cur is not None and el[2] == self.cur["post_attr"]:
            self.cur = None

    def handle_data(self, data):
        if self.cur is None:
            return
        if self.inside("dl", cls="userinfo") and self.inside("dt"):
            self.cur["user"] = (self.cur["user"] or "") + data
        elif self.inside("td", cls="postdate"):
            self.cur["date"] = (self.cur["date"] or "") + data
        elif (self.inside("td", cls="postbody") and not self.inside(cls="bbc-block")
              and not self.inside(cls="editedby")):
            self.cur["body"].append(data)


class ListingParser(_Tree):
    """Forum listing page: one record per thread row plus the component counts (H1-H3)."""

    def __init__(self):
        super().__init__()
        self.rows: list[dict] = []
        self.cur: dict | None = None
        self.n_ids = self.n_titles = self.n_authors = self.n_author_ids = 0
        self._cell: str | None = None
        self._author_seen = False

    def on_start(self, tag, a, classes):
        if tag == "tr" and "thread" in classes and self.inside("tbody"):
            self.cur = {"row_attr": a.get("id"), "title": None, "author": None, "author_href": None,
                        "replies": None, "views": None}
            self.rows.append(self.cur)
            if a.get("id"):
                self.n_ids += 1
        if tag == "a" and "thread_title" in classes:
            self.n_titles += 1
            self._cell = "title"
        if tag == "td" and self.cur is not None and classes & {"replies", "views"}:
            self._cell = "replies" if "replies" in classes else "views"
        if tag == "a" and self.cur is not None and self.inside("td", cls="author"):
            self.n_author_ids += 1
            self.cur["author_href"] = a.get("href")
            self._cell = "author"
            self._author_seen = False

    def on_end(self, tag, el):
        if tag in ("a", "td"):
            self._cell = None
        if tag == "tr" and self.cur is not None and el[2] == self.cur["row_attr"]:
            self.cur = None

    def handle_data(self, data):
        if self._cell == "author" and not self._author_seen:
            self.n_authors += 1
            self._author_seen = True
        if self.cur is not None and self._cell:
            self.cur[self._cell] = (self.cur[self._cell] or "") + data


# Subtrees whose text is not visible on the page.
HIDDEN_TAGS = {"script", "style", "nav", "head", "noscript", "template"}


class VisibleTextParser(_Tree):
    """Generic page: visible text without script/style/nav (H8)."""

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data):
        if not any(t in HIDDEN_TAGS for t, _, _ in self.stack):
            self.parts.append(data)


def _feed(parser: _Tree, html: str | None, retry_latin1: bool = True) -> tuple[_Tree, bool]:
    """Parse; on failure retry with characters outside latin-1 removed (H9)."""
    try:
        if not parser.feed_plain(html or ""):
            parser.feed(html or "")
            parser.close()
        return parser, False
    except Exception:
        if not retry_latin1:
            raise
        fresh = type(parser)()
        fresh.feed((html or "").encode("latin-1", "ignore").decode("latin-1"))
        fresh.close()
        return fresh, True


POST_ROWS_SCHEMA = ("page_id long, url string, kind string, ordinal int, thread_attr string, page_value string, "
                    "next_href string, orphan_quotes int, post_attr string, user_name string, "
                    "profile_links array<string>, date_text string, body_text string, quote_hrefs array<string>, "
                    "retried boolean")


def _post_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            p, retried = _feed(PostPageParser(), html)
            base = {"page_id": page_id, "url": url, "thread_attr": p.thread_attr, "page_value": p.page_value,
                    "next_href": p.next_href, "orphan_quotes": p.orphan_quotes, "retried": retried}
            out.append({**base, "kind": "page", "ordinal": None, "post_attr": None, "user_name": None,
                        "profile_links": None, "date_text": None, "body_text": None, "quote_hrefs": None})
            for i, r in enumerate(p.posts):
                out.append({**base, "kind": "post", "ordinal": i, "post_attr": r["post_attr"],
                            "user_name": r["user"], "profile_links": r["links"], "date_text": r["date"],
                            "body_text": "".join(r["body"]),
                            "quote_hrefs": [q["href"] for q in r["quotes"] if q["href"]]})
        yield pd.DataFrame(out, columns=[c.split()[0] for c in POST_ROWS_SCHEMA.split(", ")])


LISTING_ROWS_SCHEMA = ("page_id long, url string, kind string, ordinal int, row_attr string, title string, "
                       "author string, author_href string, replies string, views string, n_ids int, n_titles int, "
                       "n_authors int, n_author_ids int")


def _listing_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            p, _ = _feed(ListingParser(), html)
            counts = {"n_ids": p.n_ids, "n_titles": p.n_titles, "n_authors": p.n_authors,
                      "n_author_ids": p.n_author_ids}
            out.append({"page_id": page_id, "url": url, "kind": "page", "ordinal": None, "row_attr": None,
                        "title": None, "author": None, "author_href": None, "replies": None, "views": None,
                        **counts})
            for i, r in enumerate(p.rows):
                out.append({"page_id": page_id, "url": url, "kind": "row", "ordinal": i, **r, **counts})
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LISTING_ROWS_SCHEMA.split(", ")])


def _visible_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = []
        for html in pdf["html"]:
            p, _ = _feed(VisibleTextParser(), html)
            texts.append("".join(p.parts))
        yield pd.DataFrame({"page_id": pdf["page_id"], "visible_text": texts})


# ---------------------------------------------------------------- Spark side

def parse_post_pages(pages: DataFrame) -> DataFrame:
    """Raw per-page/per-post strings from thread pages (one Python pass over ``pages``)."""
    return pages.select("page_id", "url", "html").mapInPandas(_post_rows, POST_ROWS_SCHEMA)


def posts_from_pages(pages: DataFrame, forum_id=None, remove_emoji: bool = False) -> DataFrame:
    """H4-H6: post rows (post schema) from thread pages.

    thread id from ``div#thread/@class`` (D6), page from the selected option
    (D10), user id from the first of each pair of profile links (D7), date
    parsed from the date cell (D1), text = body text outside quote blocks and
    edit notes with whitespace collapsed (H5/T1), quotes = each quote block's
    link in document order, owned by the post it sits in (H6).
    """
    raw = parse_post_pages(pages)
    page = raw.where(F.col("kind") == "page")
    posts = raw.where(F.col("kind") == "post")
    text = T.collapse_whitespace("body_text")
    if remove_emoji:
        text = T.remove_emoji(text)
    forum = D.forum_id_from_url("url") if forum_id is None else F.lit(forum_id).cast("int")
    return posts.select(
        D.first_digits("post_attr").alias("post_id"),
        D.first_digits(F.element_at("profile_links", 1)).alias("user_id"),
        F.col("user_name"),
        text.alias("post_text"),
        D.normalize_page(F.col("page_value").try_cast("int")).cast("int").alias("thread_page"),
        D.parse_forum_date("date_text").alias("post_timestamp"),
        D.thread_id_from_attr("thread_attr").alias("thread_id"),
        forum.alias("forum_id"),
        F.transform("quote_hrefs", lambda h: F.regexp_extract(h, r"postid=(\d+)", 1).try_cast("bigint"))
        .alias("quoted_post_ids"),
    )


def next_pages(pages: DataFrame) -> DataFrame:
    """H7: next-page link per thread page (NULL on the last page) and the page number it points to."""
    raw = parse_post_pages(pages).where(F.col("kind") == "page")
    return raw.select("page_id", D.thread_id_from_attr("thread_attr").alias("thread_id"),
                      D.normalize_page(F.col("page_value").try_cast("int")).cast("int").alias("thread_page"),
                      "next_href",
                      F.nullif(F.regexp_extract("next_href", r"pagenumber=(\d+)", 1), F.lit("")).try_cast("int")
                      .alias("next_page"))


def parse_listing_pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html").mapInPandas(_listing_rows, LISTING_ROWS_SCHEMA)


def threads_from_listing(pages: DataFrame, with_counts: bool = False) -> DataFrame:
    """H1 (``with_counts=False``) / H2 (views, replies as text) from forum listing pages."""
    raw = parse_listing_pages(pages).where(F.col("kind") == "row")
    cols = [D.forum_id_from_url("url").alias("forum_id"),
            D.thread_id_from_attr("row_attr").alias("thread_id"),
            F.col("title").alias("thread_title"),
            F.col("author"),
            D.user_id_from_link("author_href").alias("author_id"),
            F.lit(False).alias("is_ignored")]
    if with_counts:
        cols += [F.trim("views").alias("views"), F.trim("replies").alias("replies")]
    return raw.select(*cols)


def listing_quality(pages: DataFrame) -> DataFrame:
    """H3: one row per listing page whose component counts differ (titles, author ids, authors, thread ids)."""
    raw = parse_listing_pages(pages).where(F.col("kind") == "page")
    same = ((F.col("n_titles") == F.col("n_author_ids")) & (F.col("n_author_ids") == F.col("n_authors"))
            & (F.col("n_authors") == F.col("n_ids")))
    return raw.where(~same).select("page_id", "url", "n_titles", "n_author_ids", "n_authors", "n_ids")


def page_fields(pages: DataFrame) -> DataFrame:
    """H8: title, first heading, link count, URL host and query (Column code only)."""
    return pages.select(
        "page_id",
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1).alias("heading"),
        F.size(F.regexp_extract_all("html", F.lit(r"<a\s[^>]*href=\"([^\"]*)\""), 1)).alias("n_links"),
        F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"),
    )


def visible_text(pages: DataFrame) -> DataFrame:
    """H8: visible page text (script/style/nav/head removed), whitespace collapsed and trimmed."""
    v = pages.select("page_id", "html").mapInPandas(_visible_text, "page_id long, visible_text string")
    return v.select("page_id", F.trim(T.collapse_whitespace("visible_text")).alias("visible_text"))


def latin1_fallback(pages: DataFrame) -> DataFrame:
    """H9: html with characters outside latin-1 removed (the parser retry input)."""
    return pages.select("page_id", T.strip_non_latin1("html").alias("html_latin1"))
