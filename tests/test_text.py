from pyspark.sql import functions as F

from threadlens.functions import ids as D
from threadlens.functions import text as T


def col1(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_whitespace_emoji_ascii(spark):
    assert col1(spark, ["a  b\nc\td\re"], T.collapse_whitespace("v")) == ["a b c d\re"]
    assert col1(spark, ["hi \U0001F600\U0001F680 there  x"], T.remove_emoji("v")) == ["hi  there  x"]
    assert col1(spark, ["café über"], T.strip_non_ascii("v")) == ["caf ber"]
    assert col1(spark, ["a  b"], T.collapse_whitespace("v")) == ["a b"]


def test_clean_post_rules(spark):
    vals = ["see http://x.y and more words here", "too short text", None, "one two three http", "!!! ??? ... ---"]
    out = col1(spark, vals, T.clean_post("v", 4))
    assert out == ["see and more words here", None, None, None, "!!! ??? ... ---"]
    assert col1(spark, ["  lead  and trail  "], F.size(T.as_words("v"))) == [3]


def test_word_char_filter(spark):
    assert col1(spark, ["^", ":)", "é", "_", "ok"], T.has_word_char("v")) == [False, False, True, True, True]


def test_mark_negation(spark):
    df = spark.createDataFrame([(1, "isn't fucked up. but this is fine not good never bad".split())],
                               "id long, tokens array<string>")
    got = T.mark_negation(df, "id", "tokens").first().marked
    assert got == ["isn't", "fucked_NEG", "up._NEG", "but", "this", "is", "fine", "not", "good_NEG",
                   "never", "bad_NEG"]


def test_terms_and_stop_words(spark):
    assert col1(spark, ["The Cat's ÉTÉ a_b x 42"], T.terms("v", ["the"])) == [["cat", "été", "a_b", "42"]]


def test_date_and_id_parsers(spark):
    assert col1(spark, [" Dec 1, 2016 09:05 ", "garbage"], D.parse_forum_date("v").cast("string")) == \
        ["2016-12-01 09:05:00", None]
    df = spark.createDataFrame([("x", " Jan 2, 2024 10:00 "), ("y", "   "), ("z", "bad")], "k string, d string")
    assert [r.k for r in D.clean_dates(df, "d").collect()] == ["x", "z"]
    assert col1(spark, ["post12345", "post12x", "", None], D.post_id_from_attr("v")) == [12345, None, None, None]
    ids = ["thread1234567", "thread123456", "thread10000001", "thread10000009", "thread123", "x1234567"]
    assert col1(spark, ids, D.thread_id_from_attr("v")) == [1234567, 123456, 10000001, 10000009, None, None]
    assert col1(spark, ["member.php?userid=77", "x"], D.user_id_from_link("v")) == [77, None]
    link = '<a href="showthread.php?goto=post&amp;postid=5#post5">q</a> <a href="showthread.php?goto=post&amp;postid=9">'
    assert col1(spark, [link, "nothing"], D.quoted_post_id("v")) == [9, None]
    urls = ["forumdisplay.php?forumid=44&x=1", "forumdisplay.php?forumid=5", "forumdisplay.php?a=1&forumid=123"]
    assert col1(spark, urls, D.forum_id_from_url("v")) == [44, None, 123]
    assert col1(spark, urls, D.forum_id_from_url("v", min_digits=1)) == [44, 5, 123]
    assert col1(spark, [-3, 0, 2], D.normalize_page("v"), "v int") == [1, 0, 2]


def test_whitespace_of_any_kind(spark):
    """Patterns run only on texts that need them, with the same words; minimum of words."""
    import random
    import re

    rng = random.Random(9)
    spaces = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000"]
    texts = ["".join(rng.choice(spaces[:rng.choice([1, 4, 14])] if rng.random() < 0.5 else ["a", "\u2019", "\u200b", "http://x", "\u00e9"])
                     for _ in range(rng.randrange(25))) for _ in range(500)] + ["", " ", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    cols = [T.collapse_whitespace("t").alias("c")] + [T.clean_post("t", n).alias(f"p{n}") for n in (0, 1, 2, 4)]
    for r in d.select("t", *cols).collect():
        if r.t is None:
            assert all(x is None for x in r[1:])
            continue
        assert r.c == re.sub(r"\s{2,}|\n|\t", " ", r.t)
        words = [w for w in r.t.split() if "http" not in w]
        assert [r[f"p{n}"] for n in (0, 1, 2, 4)] == [" ".join(words) if len(words) >= n else None for n in (0, 1, 2, 4)]
    plan = d.select(*cols)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan
