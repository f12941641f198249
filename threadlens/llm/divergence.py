"""Source divergence audit: how far the words of each source lie from other sources and from its language.

A term is a maximal run of letters (ASCII letters, and everything beyond ASCII) with A-Z lower-cased.  Each
language keeps its ``V`` terms that stand in at least ``min_docs`` of its documents (rows).  A group is an
occurring (language, source), or the language as a whole.  It gives every kept term, ``count`` times there, the
share ``p = 1 + floor(scale * (count + 2) / (N + 2 V))``, N the group's occurrences of kept terms.  The distance
of two shares is ``f = floor((p - q)^2 / (p + q))``.  All arithmetic is in integers.

* ``term`` rows: the kept terms a group holds with a share above the language's, by f, to rank ``top``.  f depends
  on the two counts alone, so terms fall into cells of (group count, language count); f is evaluated once a cell,
  cells of equal f are merged, the cells that can hold the first ranks are found from the running sum of their
  numbers of terms, and only these are expanded into terms, in UTF-8 order.  No window ever holds a group's terms.
* ``pair`` rows: f between a source and each other source of its language, summed over all kept terms.  A term
  that one of both lacks depends on one count only and is summed over cells (source, count); a join on the term
  adds what terms held by both differ from that.  The sums are made before the shuffle.  As asked, there is a row
  for each ordered pair of a language's sources.

Only built-in functions are used. ``f <= max(p, q)``, and shares of a group sum to about ``scale + V``, so all sums
fit into 64 bits; shares are divided as decimals.

Edge cases: a null or empty text counts as a document without terms, a null language or source as the empty one;
repeated rows are documents each; ids are not read; a language without kept terms has pairs of value 0 and no
term rows; ties are broken by the item; an empty table gives no row; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.session import cut_lineage

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else (``lower`` alone where all of it is ASCII)."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, _UPPER, _LOWER)))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, c, d``: occurrences and documents of every term. ``docs``: lang, source, text.

    A text's words and its distinct words are exploded together, so both numbers need one pass and no row per
    (document, term) is shuffled.
    """
    words = docs.select("lang", "source", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)).alias("w"))
    every = words.select("lang", "source", F.size("w").alias("n"),
                         F.posexplode(F.concat("w", F.array_distinct("w"))).alias("at", "term"))
    is_word = F.col("at") < F.col("n")
    return every.groupBy("lang", "source", "term").agg(F.sum(F.when(is_word, 1).otherwise(0)).alias("c"),
                                                       F.sum(F.when(is_word, 0).otherwise(1)).alias("d"))


def share(count: str, total: str, kept: str, scale: int) -> Column:
    """``1 + floor(scale * (count + 2) / (total + 2 * kept))``, exactly."""
    return F.expr(f"1L + CAST((CAST({scale} AS DECIMAL(20, 0)) * CAST({count} + 2 AS DECIMAL(18, 0))) "
                  f"DIV CAST({total} + 2 * {kept} AS DECIMAL(20, 0)) AS BIGINT)")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def _top_terms(kept: DataFrame, groups: DataFrame, top: int, scale: int) -> DataFrame:
    """``lang, source, item, value, rank`` of the first ``top`` terms of every group."""
    cells = (kept.groupBy("lang", "source", "c", "lang_c").agg(F.count(F.lit(1)).alias("terms"))
             .join(groups, ["lang", "source"])
             .withColumn("p", share("c", "n", "v", scale)).withColumn("q", share("lang_c", "lang_n", "v", scale))
             .where("p > q").select("lang", "source", "c", "lang_c", "terms", distance("p", "q").alias("value")))
    cells = cut_lineage(cells)
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # A value stands for at least one term, so the first ``top`` values are enough.
    values = (cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
              .withColumn("place", F.row_number().over(group)).where(F.col("place") <= top)
              .withColumn("before", F.sum("terms").over(group) - F.col("terms")).where(F.col("before") < top)
              .select("lang", "source", "value", "before"))
    wanted = cells.join(values, ["lang", "source", "value"]).select("lang", "source", "c", "lang_c", "value", "before")
    inside = Window.partitionBy("lang", "source", "value", "before").orderBy("term")
    return (kept.join(wanted, ["lang", "source", "c", "lang_c"])
            .withColumn("place", F.row_number().over(inside)).where(F.col("place") <= top)
            .withColumn("rank", (F.col("before") + F.col("place")).cast("int")).where(F.col("rank") <= top)
            .select("lang", "source", F.col("term").alias("item"), "value", "rank"))


def _pairs(kept: DataFrame, groups: DataFrame, scale: int) -> DataFrame:
    """``lang, source, item, value, rank``: every other source of the language."""
    some = groups.where("v > 0")
    base = some.select("lang", "source", "v", "n", share("0L", "n", "v", scale).alias("p0"))
    held = kept.join(base, ["lang", "source"]).withColumn("p", share("c", "n", "v", scale)).select(
        "lang", "source", "term", "p", "p0")
    held = cut_lineage(held)
    cells = held.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    # Terms of a source against a source that lacks them, from cells.
    others = base.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = (cells.join(others, "lang").where("source != item")
             .groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * distance("p", "q0")).alias("alone"),
                                                    F.sum("terms").alias("n_terms")))
    # Terms of both, as the difference from what the cells have counted for them.
    x, y = (held.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p), F.col("p0").alias(z))
            for s, p, z in (("source", "p", "p0"), ("item", "q", "q0")))
    both = (x.join(y, ["lang", "term"]).where("source < item")
            .groupBy("lang", "source", "item")
            .agg(F.sum(distance("p", "q") - distance("p", "q0") - distance("p0", "q")).alias("both"),
                 F.count(F.lit(1)).alias("n_both")))
    two = (base.join(others, "lang").where("source < item")
           .join(alone, ["lang", "source", "item"], "left")
           .join(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                              F.col("alone").alias("alone_2"), F.col("n_terms").alias("n_terms_2")),
                 ["lang", "source", "item"], "left")
           .join(both, ["lang", "source", "item"], "left").na.fill(0))
    neither = F.col("v") - F.col("n_terms") - F.col("n_terms_2") + F.col("n_both")
    value = F.col("alone") + F.col("alone_2") + F.col("both") + neither * distance("p0", "q0")
    two = two.select("lang", "source", "item", value.alias("value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where(
        "source != item")
    known = two.unionByName(two.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (every.join(known, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
            .withColumn("rank", F.row_number().over(order)))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, scale: int = 1_000_000_000, lang_col: str = "lang",
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank`` with part ``pair`` or ``term``."""
    src = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name)
                        for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = cut_lineage(term_counts(src))
    terms = (counts.groupBy("lang", "term").agg(F.sum("c").alias("lang_c"), F.sum("d").alias("docs"))
             .where(F.col("docs") >= min_docs).drop("docs"))
    kept = cut_lineage(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "c", "lang_c"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    # A language's terms and occurrences, each term once.
    langs = (kept.groupBy("lang", "term").agg(F.first("lang_c").alias("lang_c"))
             .groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_c").alias("lang_n")))
    groups = cut_lineage(src.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left")
                         .join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_n"]))
    return (_pairs(kept, groups, scale).withColumn("part", F.lit("pair"))
            .unionByName(_top_terms(kept, groups, top, scale).withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", "value", "rank"))


# The same in plain SQL: every group against every kept term of its language.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
t AS (SELECT lang, term, count(*) AS lang_c FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN t USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_c) AS lang_n FROM t GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * l.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (t.lang_c + 2)) // (l.lang_n + 2 * l.v)::HUGEINT AS q
      FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN n USING (lang, source)
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10
"""
