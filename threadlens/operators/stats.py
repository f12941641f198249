"""User statistics over the quote graph and the text.

Definitions: ``q(u)`` = quote rows whose quoted post (same thread) is by ``u``
(self-quotes excluded by default), ``p(u)`` = posts by ``u``.
most quoted = max q; noisiest = max p / (1 + q); most oblivious = min q / p
among users with p >= ``min_posts``.  Ties go to the smallest user_id.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.session import broadcast_if_small
from threadlens.operators.graph import quote_edges


def quotes_received(posts: DataFrame, exclude_self: bool = True) -> DataFrame:
    """``(user_id, quotes_received)`` for users quoted at least once."""
    e = quote_edges(posts, distinct=False)
    if exclude_self:
        e = e.where(F.col("src") != F.col("dst"))
    return e.groupBy(F.col("dst").alias("user_id")).agg(F.count(F.lit(1)).alias("quotes_received"))


def user_quote_stats(posts: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Per user: posts, quotes received, noise score p/(1+q) and quote ratio q/p."""
    p = posts.groupBy("user_id").agg(F.count("post_id").alias("posts"))
    q = quotes_received(posts, exclude_self)
    s = p.join(q, "user_id", "left").withColumn("quotes_received", F.coalesce("quotes_received", F.lit(0)))
    return s.select("user_id", "posts", "quotes_received",
                    F.round(F.col("posts") / (F.col("quotes_received") + 1), 6).alias("noise_score"),
                    F.round(F.col("quotes_received") / F.col("posts"), 6).alias("quote_ratio"))


def most_quoted_user(posts: DataFrame, exclude_self: bool = True) -> DataFrame:
    """A14."""
    q = quotes_received(posts, exclude_self)
    return q.orderBy(F.desc("quotes_received"), "user_id").limit(1)


def noisiest_user(posts: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Highest posts / (1 + quotes received)."""
    return user_quote_stats(posts, exclude_self).orderBy(F.desc("noise_score"), "user_id").limit(1)


def most_oblivious_user(posts: DataFrame, min_posts: int = 10, exclude_self: bool = True) -> DataFrame:
    """Lowest quotes received / posts among users with at least ``min_posts`` posts."""
    s = user_quote_stats(posts, exclude_self).where(F.col("posts") >= min_posts)
    return s.orderBy("quote_ratio", "user_id").limit(1)


def cuss_counts(posts: DataFrame, cusses: DataFrame | Iterable[str]) -> DataFrame:
    """Per user, occurrences of lexicon words (lower-case terms); users without any get 0.

    The word list is a small table; its measured size decides the join.
    """
    spark = posts.sparkSession
    if not isinstance(cusses, DataFrame):
        cusses = spark.createDataFrame([(w,) for w in cusses], "token string")
    lex = broadcast_if_small(cusses.select(F.lower("token").alias("token")).distinct())
    toks = posts.select("user_id", F.explode(T.terms("post_text")).alias("token"))
    c = toks.join(lex, "token", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("cusses"))
    users = posts.select("user_id").distinct()
    return users.join(c, "user_id", "left").select("user_id", F.coalesce("cusses", F.lit(0)).alias("cusses"))


def most_cusses(posts: DataFrame, cusses) -> DataFrame:
    """User with the most lexicon words."""
    return cuss_counts(posts, cusses).orderBy(F.desc("cusses"), "user_id").limit(1)


def least_cusses(posts: DataFrame, cusses) -> DataFrame:
    """User with the fewest lexicon words."""
    return cuss_counts(posts, cusses).orderBy("cusses", "user_id").limit(1)
