"""Text scalars (T1-T13) as Column expressions: JVM-side, inside whole-stage codegen.

Regex dialect note: Java's ``\\w``/``\\b`` are ASCII-only while the reference
ran Python's Unicode classes, so word characters are spelled ``[\\p{L}\\p{N}_]``.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns that must behave like the reference's.
# Python's str.split()/re "\s" whitespace set (Unicode), spelled out for Java and RE2.
PY_SPACE_CLASS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The non-ASCII members of that set; mapped to ' ' before an ASCII-whitespace split (same tokens, cheaper).
EXOTIC_SPACES = ("\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")
ASCII_SPACES = "\n\t\x0b\f\r\x1c\x1d\x1e\x1f"
WIDE_SPACES = EXOTIC_SPACES[4:]
ASCII_SPACE_RUN = r"[ \t\n\x0B\f\r]+"
# The same set again, as a class that Java decides fast: single characters below 256, the others behind one range.
SPACE_CLASS = (r"[[ \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0]"
               r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]")
WHITESPACE_PATTERN = rf"{SPACE_CLASS}(?:{SPACE_CLASS}+|(?<=[\n\t]))"
EMOJI_PATTERN = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
NON_ASCII_PATTERN = r"[^\x00-\x7F]"
NON_LATIN1_PATTERN = r"[^\x00-\xFF]"
WORD_CHAR_PATTERN = r"[\p{L}\p{N}_]"
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
URL_MARK = "http"
# Negation marking.
NEGATORS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "cannot"]
NEGATION_SUFFIX = "n't"
CLAUSE_END_PATTERN = r"^.*[.:;!?]$"
NEG_MARK = "_NEG"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _has(c: Column, chars: str) -> Column:
    """Whether any of the characters is in the text (byte searches, far cheaper than a pattern)."""
    return reduce(lambda a, b: a | b, [c.contains(ch) for ch in chars])


def _has_wide_space(c: Column) -> Column:
    """Whether whitespace beyond ASCII is in the text; the many signs of one block are looked for only if its first bytes are there."""
    def starts(lead: str) -> Column:
        return F.contains(c.cast("binary"), F.expr(f"X'{lead}'"))

    block = [ch for ch in WIDE_SPACES if ch.encode()[:2] == b"\xe2\x80"]
    few = [starts(ch.encode().hex()) for ch in WIDE_SPACES if ch not in block]
    return reduce(lambda a, b: a | b, few) | (starts("E280") & _has(c, "".join(block)))


def _blanks(c: Column, chars: str) -> Column:
    """Each of the characters -> a space, then runs of spaces -> one space."""
    spaced = reduce(lambda a, ch: F.replace(a, F.lit(ch), F.lit(" ")), chars, c)
    return bind(spaced, lambda s: F.when(s.contains("  "), F.regexp_replace(s, " {2,}", " ")).otherwise(s))


def collapse_whitespace(c) -> Column:
    """Runs of >= 2 whitespace, any newline or tab -> one space (a lone CR stays).

    The pattern only runs on texts that hold whitespace other than spaces, newlines and tabs.
    """
    return bind(_c(c), lambda t: F.when(_has(t, ASCII_SPACES[2:]) | _has_wide_space(t), F.regexp_replace(t, WHITESPACE_PATTERN, " "))
                .otherwise(_blanks(t, ASCII_SPACES[:2])))


def remove_emoji(c) -> Column:
    """Drop code points in the four emoji blocks."""
    return F.regexp_replace(_c(c), EMOJI_PATTERN, "")


def strip_non_ascii(c) -> Column:
    """Drop every character outside ASCII."""
    return F.regexp_replace(_c(c), NON_ASCII_PATTERN, "")


def strip_non_latin1(c) -> Column:
    """H9: drop every character outside latin-1 (parser retry)."""
    return F.regexp_replace(_c(c), NON_LATIN1_PATTERN, "")


def single_spaced(c) -> Column:
    """Whitespace runs (Python's set) -> one space, trimmed: ``' '.join(text.split())`` without the array."""
    return F.trim(bind(_c(c), lambda t: F.when(_has_wide_space(t), F.regexp_replace(t, f"{SPACE_CLASS}+", " "))
                       .otherwise(_blanks(t, ASCII_SPACES))))


def word_count(spaced: Column) -> Column:
    """Number of tokens of a ``single_spaced`` text (arithmetic, no array)."""
    return F.when(spaced == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)


def _has_words(spaced: Column, n: int) -> Column:
    """``word_count(spaced) >= n``, looking no further than the n-th word."""
    if n < 2:
        return F.octet_length(spaced) >= n
    return F.octet_length(F.substring_index(spaced, " ", n - 1)) < F.octet_length(spaced)


def as_words(c) -> Column:
    """Whitespace tokenization like Python's ``str.split()`` (no empty tokens)."""
    norm = F.translate(_c(c), EXOTIC_SPACES, " " * len(EXOTIC_SPACES))
    return F.array_remove(F.split(norm, ASCII_SPACE_RUN), "")


def drop_url_tokens(tokens) -> Column:
    """T4: drop tokens containing 'http'."""
    return F.filter(_c(tokens), lambda x: ~x.contains(URL_MARK))


def as_sentence(tokens) -> Column:
    """Tokens joined by one space."""
    return F.array_join(_c(tokens), " ")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (Spark does not share subexpressions
    across conditional branches, so an expensive value used in several branches is bound first)."""
    return F.transform(F.array(value), body)[0]


def _spaced_without_urls(c) -> Column:
    """Single-spaced text with URL tokens removed; the token path runs only for texts containing 'http'."""
    return bind(single_spaced(c), lambda sp: F.when(
        sp.contains(URL_MARK), F.array_join(drop_url_tokens(F.split(sp, " ")), " ")).otherwise(sp))


def clean_post(c, min_words: int = 4) -> Column:
    """T5: URL tokens removed; NULL when fewer than ``min_words`` tokens remain."""
    return bind(_spaced_without_urls(c), lambda sp: F.when(_has_words(sp, min_words), sp))


def clean_posts_frame(df: DataFrame, text: str = "post_text", min_words: int = 4, out: str = "clean_text",
                      keep_null: bool = True) -> DataFrame:
    """T5 over a frame, tokenizing once (the token array is a column, not recomputed per use)."""
    d = df.withColumn(out, clean_post(text, min_words))
    return d if keep_null else d.where(F.col(out).isNotNull())


def clean_post_tokens(c, min_words: int = 4) -> Column:
    """T5/T6 token form: NULL when fewer than ``min_words`` tokens remain."""
    toks = drop_url_tokens(as_words(c))
    return F.when(F.size(toks) >= min_words, toks)


def clean_posts(df: DataFrame, text: str = "post_text", min_words: int = 4, as_tokens: bool = False,
                out: str = "clean_text") -> DataFrame:
    """Cleaned text (or token array), short posts dropped."""
    v = clean_post_tokens(text, min_words) if as_tokens else clean_post(text, min_words)
    return df.withColumn(out, v).where(F.col(out).isNotNull())


def flatten_tokens(df: DataFrame, tokens: str = "tokens", out: str = "token") -> DataFrame:
    """One row per token, with its position."""
    keep = [c for c in df.columns if c != tokens]
    return df.select(*keep, F.posexplode(tokens).alias("pos", out))


def remove_newlines(c) -> Column:
    """Remove every newline."""
    return F.replace(_c(c), F.lit("\n"), F.lit(""))


def has_word_char(c) -> Column:
    """True when the text holds a word character (Unicode-aware)."""
    return _c(c).rlike(WORD_CHAR_PATTERN)


def terms(c, stop_words: Iterable[str] | None = None) -> Column:
    """Lower-case word terms of >= 2 word characters, stop words removed (order and repeats kept)."""
    toks = F.regexp_extract_all(F.lower(_c(c)), F.lit(TERM_PATTERN), 0)
    if stop_words:
        stop = sorted(set(stop_words))
        toks = F.filter(toks, lambda x: ~x.isin(*stop))  # planned as a hash set lookup (InSet)
    return toks


def english_stop_words() -> list[str]:
    """Spark's built-in English stop-word list (public MLlib API)."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


def is_negator(x: Column) -> Column:
    return x.isin(*NEGATORS) | x.endswith(NEGATION_SUFFIX)


def mark_negation_rows(df: DataFrame, key: str, tokens: str = "tokens", out: str = "token") -> DataFrame:
    """T10, row form: one row per token ``(key, pos, token)`` with negation marks.

    A token is marked '_NEG' when a negator occurs earlier in the same post and
    no clause-ending token (one that ends in . : ; ! ?) lies between that
    negator and it; the clause-ending token itself is still marked and closes
    the scope; negators are never marked, and a second negator keeps the scope
    open.  Linear: running maxima over a window ordered by position inside one
    post (a post is bounded by one document's length).
    """
    x = df.select(key, F.posexplode(tokens).alias("pos", "_t"))
    lx = F.lower(F.col("_t"))
    x = x.withColumn("_neg", is_negator(lx)).withColumn("_end", F.col("_t").rlike(CLAUSE_END_PATTERN))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last_neg = F.max(F.when(F.col("_neg"), F.col("pos"))).over(w)
    last_end = F.max(F.when(F.col("_end"), F.col("pos"))).over(w)
    x = x.withColumn("_ln", last_neg).withColumn("_le", last_end)
    inside = F.col("_ln").isNotNull() & (F.col("_le").isNull() | (F.col("_le") < F.col("_ln"))) & ~F.col("_neg")
    return x.select(key, "pos", F.when(inside, F.concat("_t", F.lit(NEG_MARK))).otherwise(F.col("_t")).alias(out))


def mark_negation(df: DataFrame, key: str, tokens: str = "tokens", out: str = "marked") -> DataFrame:
    """T10, array form: ``(key, marked)`` with tokens in their original order."""
    rows = mark_negation_rows(df, key, tokens, "_tok")
    return rows.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "_tok"))), lambda s: s["_tok"]).alias(out))


def comma_join(values) -> Column:
    """T13 (aggregate): ids sorted ascending, joined by commas."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(_c(values))), lambda x: x.cast("string")), ",")
