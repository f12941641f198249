"""Quality rules: a threshold table compiled into one Spark projection (no user functions).

Words are maximal runs of characters other than space and U+0009..U+000D.  ``measure`` adds the
counts, ``verdict`` turns a rule table into one boolean column, ``apply_rules`` does both.

Edge cases: null and empty texts have zero counts and fail the base rule; a text of fewer than
eight words has no repeated window; extra columns of the input are not carried, so their names
cannot clash.  Repeated rows each get their own result row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_RUN = "[\\x20\\x09-\\x0D]+"
WORD_CHAR = "[^\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"
REPEAT_WINDOW = 8

# Frequent function words of the languages served (compared in lower case).
STOP_WORDS = tuple(sorted(set((
    "a an and are as at be by for from have he in is it not of on or that the this to was were with you "
    "au avec ce dans de des du elle en est et il je la le les ne nous pas pour qu que qui se son sur un une "
    "auf das dem den der des die ein eine es für ich im in ist mit nicht sie sich und von zu "
    "como con de del el en es la las lo los más no para pero por que se sin su un una y"
).split())))


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``low <= 100 * numerator / denominator <= high`` (None: no bound).

    Counts are compared in whole numbers; a zero denominator passes, the base rule judges it.
    """

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        num, den = 100 * F.col(self.numerator), F.col(self.denominator)
        tests = [num >= self.low * den] if self.low is not None else []
        tests += [num <= self.high * den] if self.high is not None else []
        return reduce(lambda x, y: x & y, tests, F.lit(True))


PRODUCTION_RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols_per_word", "n_symbols", "n_words", high=10),
    Rule("stop_word_share", "n_stop_words", "n_words", low=5),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", high=50),
    Rule("stuttered_word_share", "n_stutters", "n_words", high=30),
)


def verdict(rules: Sequence[Rule]) -> Column:
    """The conjunction of all rules as one boolean expression."""
    return reduce(lambda x, y: x & y, (r.passes() for r in rules), F.lit(True))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Counts per text: words, characters, symbols, lines, stop words and repeated windows.

    Large intermediate arrays are named in steps of their own, so that each is evaluated once.
    """
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select(id_col, "_t", F.btrim("_t", F.lit(SEPARATORS)).alias("_c"))
    d = d.select(
        id_col,
        F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.when(F.col("_c") == "", F.array().cast("array<string>"))
        .otherwise(F.split("_c", SEPARATOR_RUN)).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD_CHAR)).alias("_lines"))
    d = d.select(
        id_col, "n_symbols", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_w", lambda w, i: (i > 0) & (w == F.get("_w", i - 1)))).cast("long").alias("n_stutters"),
        F.when(F.size("_w") >= REPEAT_WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_w") - (REPEAT_WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("_w", i, F.lit(REPEAT_WINDOW))))).alias("_h"))
    # Only texts that do repeat a window pay for finding where.
    d = d.withColumn("_s", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_p", F.array_sort(F.transform(
        F.filter("_s", lambda e, j: F.coalesce(e["h"] == F.get("_s", j - 1)["h"], F.lit(False))
                 | F.coalesce(e["h"] == F.get("_s", j + 1)["h"], F.lit(False))),
        lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_p", lambda p, j: F.when(j == 0, F.lit(REPEAT_WINDOW)).otherwise(
            F.least(F.lit(REPEAT_WINDOW), p - F.get("_p", j - 1)))),
        F.lit(0), lambda a, x: a + x)
    return d.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
                    "n_lines", "n_stop_words", "n_stutters")


def base_failed() -> Column:
    """The rule every text must pass first: 20 words, and at most 30 % of words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = PRODUCTION_RULES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Counts of every text with ``base_failed`` and ``kept``; one row per input row, no shuffle."""
    return (measure(docs, id_col, text_col)
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))


def _sql_rule(r: Rule) -> str:
    parts = [f"100 * {r.numerator} >= {r.low} * {r.denominator}"] if r.low is not None else []
    parts += [f"100 * {r.numerator} <= {r.high} * {r.denominator}"] if r.high is not None else []
    return " AND ".join(parts) or "true"


def oracle(rules: Sequence[Rule] = PRODUCTION_RULES) -> str:
    """The same counts in DuckDB SQL: windows and lines are unnested and counted by key."""
    stops = ", ".join("'" + w + "'" for w in STOP_WORDS)
    tests = " AND ".join(_sql_rule(r) for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS g FROM pos),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) x WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM rep) y GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stutters
      FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {tests} AS kept FROM f
"""
