"""Spelling variants: words within one edit of a much commoner word, found by a variable-length gram index.

A run is a maximal run of Latin letters (A-Z, a-z and U+00C0 to U+00FF) with A-Z lower-cased.  One run in about
``every`` loses a letter by a hash of its document and itself, which plants known variants.  A word is a distinct
result of at least ``min_chars`` code points and ``min_count`` occurrences.

1. The gram dictionary: counts of all grams of ``QMIN`` to ``QMAX`` code points over the words (with a mark at both
   ends).  A gram longer than ``QMIN`` is in it if its count is at least ``rare`` and the gram one shorter stands in
   more than ``LIST_WORDS`` places, so that long lists are split up and short ones stay whole.  ``rare`` rises with
   the words so that at most ``DICTIONARY`` grams are counted as common: that bounds what the driver gathers and
   the tasks are sent.
2. A word is cut into the longest dictionary gram at each place (one of ``QMIN`` letters where there is none), without
   those inside another one.  One edit at a place changes the grams over that place, those left of it that lie in
   a stretch that begins a longer dictionary gram, and those right of it that lie in a stretch that ends one.  The
   most grams that any edit can change is the word's bound.
3. Two words one edit apart share, at the same place from the same end, all but so many of their grams.  So one of
   their ``bound + 1`` rarest grams is shared, and only these lists are merged: a key is the gram, its place and the
   length of the shorter word.  A word whose bound reaches its number of grams has these keys over plain grams of
   ``QMIN`` as well, of which an edit changes two; a pair of such words meets there.
4. What meets goes on if the parities of the hashed letters differ in at most two bits, and is verified by its edit
   distance, inside the join, so lists are not written out as pairs.

A word's form is its near word with the most occurrences if that has at least ``factor`` times its own. Forms are
followed up to the last one by pointer doubling (the counts grow on the way, so the rounds are few).

Edge cases: null and empty texts hold no run; a null id counts as an empty one in the hash; repeated rows count each;
ties between near words go to the first one in code point order; a table without words gives no row; extra columns
are not carried.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm import words as W
from threadlens.llm.divergence import lower_ascii
from threadlens.session import cut_lineage

RUN = "[A-Za-zÀ-ÿ]+"
QMIN, QMAX = 2, 4
LIST_WORDS = 300        # a gram in more places than this is split up by longer ones
RARE = 20               # longer grams in fewer places than this stay with the shorter one
DICTIONARY = 200_000    # most grams that may be counted as common
_BEGIN, _END = "^", "$"


def word_counts(docs: DataFrame, every: int = 97, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n``. ``docs``: id, text."""
    runs = docs.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return (runs.select("run", h.alias("h")).select(word.alias("word"))
            .where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def common_grams(words: DataFrame, rare: int = RARE, dictionary: int = DICTIONARY) -> dict[str, int]:
    """Counts of the grams of the words that stand in at least ``rare`` places (more, if they would be too many)."""
    marked = words.select(F.concat(F.lit(_BEGIN), "word", F.lit(_END)).alias("x"))
    total = marked.agg(F.sum(F.char_length("x"))).first()[0] or 0
    least = max(rare, -(-total * (QMAX - QMIN + 1) // dictionary))
    size = F.char_length("x")
    places = marked.select("x", size.alias("size"), F.explode(F.sequence(F.lit(1), size - QMIN + 1)).alias("at"))
    grams = places.select(F.explode(F.array(*(
        F.when(F.col("at") + k - 1 <= F.col("size"), F.substring("x", F.col("at"), F.lit(k)))
        for k in range(QMIN, QMAX + 1)))).alias("gram"))
    found = (grams.where("gram IS NOT NULL").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= least))
    return {r["gram"]: r["n"] for r in found.collect()}     # at most ``dictionary`` of them


class Grams:
    """A pruned dictionary of variable-length grams, and the words' cuts and bounds under it."""

    def __init__(self, counts: dict[str, int], list_words: int = LIST_WORDS):
        self.counts = counts
        self.grams = {g for g in counts if len(g) > QMIN and counts.get(g[:-1], 0) > list_words}
        # Beginnings and ends of longer grams that may hold a gram.
        self.heads = {g[:k] for g in self.grams for k in range(QMIN, len(g))}
        self.tails = {g[-k:] for g in self.grams for k in range(QMIN, len(g))}
        self.longest = max(map(len, self.grams), default=QMIN)

    def cut(self, x: str) -> tuple[list[int], list[int]]:
        """First and last place of each gram of a marked word; both rise."""
        n, grams = len(x), self.grams
        first, last, top = [], [], -1
        for i in range(n - QMIN + 1):
            end = i + QMIN - 1
            for k in range(min(self.longest, n - i), QMIN, -1):
                if x[i:i + k] in grams:
                    end = i + k - 1
                    break
            if end > top:
                first.append(i)
                last.append(end)
                top = end
        return first, last

    def bound(self, x: str, first: list[int], last: list[int]) -> int:
        """The most grams that one inserted, deleted or replaced letter between the marks can change."""
        n, m, longest = len(x), len(first), self.longest - 1
        left, right = [0] * n, [0] * (n + 1)
        for e in range(n):          # grams that end by e, and do not lie in a head that ends there
            begin = e + 1
            for k in range(min(longest, e + 1), QMIN - 1, -1):
                if x[e - k + 1:e + 1] in self.heads:
                    begin = e - k + 1
                    break
            left[e] = min(bisect_right(last, e), bisect_left(first, begin))
        for b in range(n):          # grams that begin from b on, and do not lie in a tail that begins there
            end = b - 1
            for k in range(min(longest, n - b), QMIN - 1, -1):
                if x[b:b + k] in self.tails:
                    end = b + k - 1
                    break
            right[b] = min(m - bisect_left(first, b), m - bisect_right(last, end))
        # An edit between places i - 1 and i, or of the letter at i.
        untouched = min(min(left[i - 1] + right[i], left[i - 1] + right[i + 1] if i < n - 1 else m)
                        for i in range(1, n))
        return m - untouched

    def rarest(self, x: str) -> tuple[list[tuple[str, int]], bool]:
        """The (gram, place) of the word's lists, rarest first, and whether the bound leaves any gram untouched."""
        first, last = self.cut(x)
        most = self.bound(x, first, last)
        order = sorted((self.counts.get(x[a:b + 1], 0), x[a:b + 1], a) for a, b in zip(first, last))
        return [(g, a) for _, g, a in order[:most + 1]], most < len(first)


def gram_keys(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``key, word, n, bits, longer``: a word's lists by its own length, and (``longer``) by the length below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The plain cut: no gram longer than QMIN, in the same order of rarity.
        cuts = (Grams(counts), Grams({g: n for g, n in counts.items() if len(g) == QMIN}))
        for batch in batches:
            names = batch.column(0).to_pylist()
            keys, row, longer, bits = [], [], [], []
            for i, word in enumerate(names):
                x, size, parity = _BEGIN + word + _END, len(word), 0
                for c in word:
                    parity ^= 1 << (ord(c) * 0x9E3779B1 >> 7 & 63)
                bits.append(parity - (1 << 64) if parity >> 63 else parity)
                for kind, grams in enumerate(cuts):
                    lists, enough = grams.rarest(x)
                    for gram, at in lists:
                        keys += ((gram, kind, at, size), (gram, kind, at, size - 1), (gram, kind, at - 1, size - 1))
                        longer += (False, True, True)
                        row += (i, i, i)
                    if enough:
                        break
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(_key_hashes(keys)), batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(bits, pa.int64()).take(at), pa.array(longer, pa.bool_())],
                names=["key", "word", "n", "bits", "longer"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, bits long, longer boolean")


def _key_hashes(keys: list[tuple[str, int, int, int]]) -> np.ndarray:
    """64-bit hashes of (gram, kind, place, length). Words that meet by a collision fail the verification."""
    if not keys:
        return np.zeros(0, dtype=np.int64)
    grams = np.array([k[0] for k in keys], dtype=f"U{QMAX}").view(np.uint32).reshape(len(keys), -1).astype(np.uint64)
    rest = np.array([k[1:] for k in keys], dtype=np.int64).astype(np.uint64)
    h = np.zeros(len(keys), dtype=np.uint64)
    for column in (*grams.T, *rest.T):
        h = W.mix64(h * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
    return W.as_signed(h)


def near_words(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``word, n, near, near_n``: both directions of every pair of words one edit apart."""
    keys = cut_lineage(gram_keys(words, counts))
    short = keys.where("NOT longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    other = keys.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), "longer")
    near = ((F.col("longer") | (F.col("a") < F.col("b")))
            & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= 2)
            & (F.levenshtein("a", "b", 1) == 1))
    pairs = cut_lineage(short.join(other, "key").where(near).select("a", "n_a", "b", "n_b").distinct())
    return pairs.toDF("word", "n", "near", "near_n").unionByName(pairs.toDF("near", "near_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words with a ``form``: the last one on the way."""
    top = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        up = top.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(top.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        top = step.select("word", "root")


def variants(docs: DataFrame, every: int = 97, min_chars: int = 5, min_count: int = 3, factor: int = 2,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = cut_lineage(word_counts(src, every, min_chars, min_count))
    near = near_words(words, common_grams(words))
    best = F.min(F.struct((-F.col("near_n")).alias("least"), "near"))
    per = (near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
           .select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.least")).alias("near_n")))
    enough = F.col("near_n") >= factor * F.col("n")
    per = cut_lineage(per.select("word", "n_near", F.when(enough, F.col("near")).alias("form"),
                                 F.when(enough, F.col("near_n")).alias("form_n")))
    up = roots(per.where("form IS NOT NULL"))
    return (words.join(per, "word", "left").join(up, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))


# Plain SQL: crc32 by its table, near words by what is left when one letter is taken out.
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
          CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY k) AS t
        FROM (SELECT unnest(range(256))::BIGINT AS k)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
u AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x, count(*) AS c FROM r GROUP BY doc_id, run),
h AS (SELECT run, c, xor(4294967295::BIGINT, list_reduce(list_transform(range(0, length(x) // 2),
             lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8), 4294967295::BIGINT)) AS h
      FROM u, crc),
e AS (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
             ELSE run END AS word FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT DISTINCT v.word, v.n, w.word, w.n FROM v JOIN w ON v.rest = w.word
      UNION SELECT DISTINCT w.word, w.n, v.word, v.n FROM v JOIN w ON v.rest = w.word),
b AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min({'c': -near_n, 'w': near}) AS b FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.b.c >= 2 * w.n THEN b.b.w END AS form,
        CASE WHEN -b.b.c >= 2 * w.n THEN -b.b.c END AS form_n FROM w LEFT JOIN b USING (word)),
up AS (SELECT word, word AS root, form AS nxt FROM f
       UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON up.nxt = f.word)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.nxt IS NULL
"""
