"""Date, id and URL scalars (D1-D11) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats and patterns of the forum markup.
FORUM_DATE_FORMAT = "MMM d, yyyy HH:mm"
SQL_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
FORUM_ID_PATTERN = r"(?:^|&)forumid=(\d{%d,})"
THREAD_ID_PATTERN = r"thread(\d{%d,})"
FIRST_DIGITS_PATTERN = r"(\d+)"
USER_ID_PATTERN = r"userid=(\d+)"
POST_ID_PATTERN = r"^post(\d+)$"
QUOTE_LINK_PATTERN = r"^(.*showthread\.php\?goto=post&amp;postid=)(\d+)"
QUOTE_LINK_ALL_PATTERN = r"showthread\.php\?goto=post&amp;postid=(\d+)"
THREAD_URL_FORMAT = "%s/showthread.php?threadid=%d&userid=0&perpage=%d&pagenumber=%d"
THREAD_URL_SHORT_FORMAT = "%s/showthread.php?threadid=%d"
DEFAULT_BASE_URL = "https://forum.invalid"
POSTS_PER_PAGE = 40
RELEASE_OFFSET_DAYS = 14


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def parse_forum_date(c) -> Column:
    """Trimmed ``Mon D, YYYY HH:MM`` -> timestamp; blank or malformed -> NULL."""
    return F.try_to_timestamp(F.trim(_c(c)), F.lit(FORUM_DATE_FORMAT))


def clean_dates(df: DataFrame, c: str, out: str = "post_timestamp") -> DataFrame:
    """Blank date strings are dropped together with their row."""
    return df.where(F.trim(F.col(c)) != "").withColumn(out, parse_forum_date(c))


def epoch_millis(c) -> Column:
    """Timestamp -> epoch milliseconds (session time zone is UTC)."""
    return F.unix_millis(_c(c).cast("timestamp"))


def parse_sql_timestamp(c) -> Column:
    """D3: ``YYYY-MM-DD HH:MM:SS`` -> timestamp; malformed -> NULL."""
    return F.try_to_timestamp(_c(c), F.lit(SQL_TS_FORMAT))


def release_cutoff(c, days: int = RELEASE_OFFSET_DAYS) -> Column:
    """Release date + ``days``."""
    return F.date_add(_c(c), days)


def forum_id_from_url(c, min_digits: int = 2) -> Column:
    """The digits after ``forumid=`` in the URL query (at least ``min_digits``), else NULL."""
    query = F.regexp_extract(_c(c), r"\?([^#]*)", 1)
    return _nullif_empty(F.regexp_extract(query, FORUM_ID_PATTERN % min_digits, 1)).try_cast("int")


def thread_id_from_attr(c, min_digits: int = 6) -> Column:
    """The whole run of digits after ``thread`` (at least ``min_digits`` of them), else NULL."""
    return _nullif_empty(F.regexp_extract(_c(c), THREAD_ID_PATTERN % min_digits, 1)).try_cast("bigint")


def first_digits(c) -> Column:
    """First run of digits, else NULL."""
    return _nullif_empty(F.regexp_extract(_c(c), FIRST_DIGITS_PATTERN, 1)).try_cast("bigint")


def user_id_from_link(c) -> Column:
    """``userid=<digits>`` from a profile link."""
    return _nullif_empty(F.regexp_extract(_c(c), USER_ID_PATTERN, 1)).try_cast("bigint")


def post_id_from_attr(c) -> Column:
    """Whole string ``post<digits>`` -> the digits, else NULL."""
    return _nullif_empty(F.regexp_extract(_c(c), POST_ID_PATTERN, 1)).try_cast("bigint")


def quoted_post_id(c) -> Column:
    """Quoted post id from a quote link; greedy, so the last link on the first line wins."""
    return _nullif_empty(F.regexp_extract(_c(c), QUOTE_LINK_PATTERN, 2)).try_cast("bigint")


def quoted_post_ids_all(c) -> Column:
    """D9 option: every quoted post id in the text."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit(QUOTE_LINK_ALL_PATTERN), 1), lambda x: x.cast("bigint"))


def normalize_page(c) -> Column:
    """Negative page numbers become 1."""
    p = _c(c)
    return F.when(p < 0, F.lit(1)).otherwise(p)


def thread_url(thread_id, page=None, base_url: str = DEFAULT_BASE_URL, per_page: int = POSTS_PER_PAGE) -> Column:
    """Thread URL, with page when given."""
    if page is None:
        return F.format_string(THREAD_URL_SHORT_FORMAT, F.lit(base_url), _c(thread_id))
    return F.format_string(THREAD_URL_FORMAT, F.lit(base_url), _c(thread_id), F.lit(per_page), _c(page))
