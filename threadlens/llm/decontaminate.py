"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct word shingles into doubling size classes.  For a class
of at most ``u`` shingles a document is seen as overlapping windows of ``2 u`` shingles with a step of
``u`` (minima of blocks of ``u``, then of neighbouring blocks), so an item that stands anywhere in a long
document lies whole inside one window whose similarity to it does not depend on the document's length.
A window and an item that agree in any of ``hashes`` min-hashes make a candidate; it is verified exactly:
at least ``percent`` of the item's shingles must be in the whole document's set.

With 64 hashes an item at the threshold in the worst place of its class is missed with probability 2e-6
(similarity 0.19 or more), one fully contained with less than 1e-8.  An item of a single shingle is looked up
by the shingle itself.

The index is a table of (key, item), a key for every min-hash of an item, and never leaves Spark.  Tasks that read
documents hold two bitmaps of a bounded size: one of all keys, one of all shingles of items.  A document leaves its
task only if a window's key is in the first one, and then as those keys and as its shingles that are in the second
one.  Keys meet the index in a join; what the bitmaps let through by chance finds no item or is not shared in the
exact count.  Only the bitmaps and the list of size classes come to the driver.

Edge cases: an item of fewer than ``k`` words is one shingle of all of them, sought as a run of words of that
length; an item without words, or null, matches nothing; so do null, empty and short documents.  Repeated items and
documents are each reported; ``clean_rows`` knows a document by its text, so copies go together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm import words as W
from threadlens.llm.minhash import Hasher
from threadlens.session import cut_lineage

SLICE_BYTES = 1 << 20
LEAST_BITS, MOST_BITS = 22, 28      # of a bitmap: 0.5 to 32 MB
_SEED = 9


@dataclass(frozen=True)
class Bitmap:
    """A set of 64-bit keys, seen through two bits of each."""

    bits: int
    words: np.ndarray       # uint64

    def has(self, keys: np.ndarray) -> np.ndarray:
        """The places in ``keys`` of those that may be in the set."""
        at = np.flatnonzero(self._bit(keys >> np.uint64(64 - self.bits)))
        return at[self._bit(keys[at] & np.uint64((1 << self.bits) - 1))]

    def _bit(self, place: np.ndarray) -> np.ndarray:
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def bitmap_of(keys: DataFrame, column: str, n: int) -> Bitmap:
    """The bitmap of a column of keys (32 bits a key, within the bounds). Its words are made by an aggregate."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(32 * max(n, 1)).bit_length()))
    places = F.array(F.shiftrightunsigned(column, 64 - bits), F.col(column).bitwiseAND(F.lit((1 << bits) - 1)))
    # ``1 << place`` takes the place modulo 64.
    rows = (keys.select(F.explode(places).alias("place"))
            .groupBy(F.shiftright("place", 6).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("word")).toPandas())
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy().astype(np.int64).view(np.uint64)
    return Bitmap(bits, out)


def _sized(g: np.ndarray, q: int) -> np.ndarray:
    """Shingle hashes that know their number of words."""
    return W.mix64(g + W.mix64(np.array([q], dtype=np.uint64)))


def _key(minimum: np.ndarray, q: int, width: int, j: int) -> np.ndarray:
    return W.mix64(minimum ^ W.mix64(np.array([(q << 40) + (width << 8) + j + 1], dtype=np.uint64)))


def item_rows(items: DataFrame, k: int, lower: bool, hashes: int, item_col: str, text_col: str) -> DataFrame:
    """``row, item_id, q, width, shingles, keys`` of every item that has a word."""
    src = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("_text"))
    item_type = dict(src.dtypes)["item_id"]
    hasher = Hasher(hashes, seed=_SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in W.slices(batch.column(1), SLICE_BYTES):
                w = W.split_words(batch.column(1).slice(a, b - a))
                g, first = W.ngrams(w, w.hashes(lower=lower), k)
                own = np.flatnonzero(w.counts)
                cols: list[list] = [[] for _ in range(4)]
                for i in own:
                    q = int(min(k, w.counts[i]))
                    s = np.unique(_sized(g[first[i]:first[i + 1]], q))
                    width = 1 << int(len(s) - 1).bit_length()
                    low = s[None] if width == 1 else hasher.minima(s, np.zeros(1, dtype=np.int64))
                    keys = [int(W.as_signed(_key(low[:, j], q, width, j))[0]) for j in range(low.shape[1])]
                    for c, x in zip(cols, (q, width, W.as_signed(s), keys)):
                        c.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(len(own))), batch.column(0).take(pa.array(a + own, pa.int64())),
                     pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())),
                     pa.array(cols[3], pa.list_(pa.int64()))], names=["row", "item_id", "q", "width", "shingles", "keys"])
                number += len(own)

    return src.mapInArrow(run, f"row long, item_id {item_type}, q int, width long, shingles array<long>, keys array<long>")


class Windows:
    """What a task looks for: size classes by shingle length, and the bitmaps."""

    def __init__(self, classes: list[tuple[int, int]], keys: Bitmap, shingles: Bitmap, k: int, lower: bool, hashes: int):
        self.keys, self.shingles, self.k, self.lower = keys, shingles, k, lower
        self.hasher = Hasher(hashes, seed=_SEED)
        self.widths = {q: sorted(u for p, u in classes if p == q) for q in sorted({p for p, _ in classes})}

    def search(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, keys, shingles) of the texts with a window whose key may be an item's."""
        w = W.split_words(column)
        h = w.hashes(lower=self.lower)
        sized: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        texts, keys = [], []
        for q, widths in self.widths.items():
            g, first = W.ngrams(w, h, q, short=False)
            g = _sized(g, q)
            sized[q] = g, first
            if len(g):
                for t, x in self._hits(g, first, q, widths):
                    texts.append(t)
                    keys.append(x)
        if not texts:
            return
        text, key = np.concatenate(texts), np.concatenate(keys)
        order = np.argsort(text, kind="stable")
        text, key = text[order], key[order]
        for i in np.unique(text):
            lo, hi = np.searchsorted(text, (i, i + 1))
            own = np.unique(np.concatenate([g[first[i]:first[i + 1]] for g, first in sized.values()]))
            yield int(i), np.unique(key[lo:hi]), own[self.shingles.has(own)]

    def _hits(self, g: np.ndarray, first: np.ndarray, q: int, widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = np.diff(first)
        some = np.flatnonzero(n)
        if widths[0] == 1:      # single shingles, as they are
            key = _key(g, q, 1, 0)
            at = self.keys.has(key)
            yield np.searchsorted(first, at, side="right") - 1, key[at]
            widths = widths[1:]
        if not widths:
            return
        # Blocks of the smallest width; those of a doubled width are two neighbours of the same text.
        layers, base = [], widths[0]
        blocks = -(-n[some] // base)
        start = np.repeat(first[some], blocks) + base * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        width = base
        while width <= widths[-1]:
            begin = np.cumsum(blocks) - blocks
            text = np.repeat(some, blocks)
            halves = -(-blocks // 2)
            pairs = np.repeat(begin, halves) + 2 * (np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves))
            layers.append((width, text, text[1:] == text[:-1], pairs))
            blocks, width = halves, 2 * width
        buf = np.empty_like(g)
        for j in range(self.hasher.n):      # one hash at a time: nothing grows with their number
            np.bitwise_xor(g, self.hasher.flip[j], out=buf)
            np.multiply(buf, self.hasher.mult[j], out=buf)
            low = np.minimum.reduceat(buf, start)
            for width, text, joined, pairs in layers:
                if width in widths:
                    window = low.copy()
                    np.minimum(low[:-1], low[1:], out=window[:-1], where=joined)
                    key = _key(window, q, width, j)
                    at = self.keys.has(key)
                    if len(at):
                        yield text[at], key[at]
                low = np.minimum.reduceat(low, pairs)


def _candidates(src: DataFrame, items: DataFrame, k: int, percent: int, hashes: int, lower: bool, item_col: str,
                item_text_col: str) -> DataFrame:
    """``key, item_id, n_shared, n_item`` of all verified matches. ``src``: any ``key``, and ``_text``."""
    table = cut_lineage(item_rows(items, k, lower, hashes, item_col, item_text_col))
    index = table.select(F.explode("keys").alias("mark"), F.col("row").alias("item"))
    shingles = table.select(F.explode("shingles").alias("mark")).distinct()
    classes = [(r["q"], r["width"]) for r in table.select("q", "width").distinct().collect()]
    n = table.agg(F.sum(F.size("keys")).alias("keys"), F.sum(F.size("shingles")).alias("shingles")).first()
    look = Windows(classes, bitmap_of(index, "mark", n["keys"] or 0), bitmap_of(shingles, "mark", n["shingles"] or 0),
                   k, lower, hashes)
    key_field = src.schema["key"]
    names = ["row", "key", "marks", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in W.slices(batch.column(1), SLICE_BYTES):
                found = list(look.search(batch.column(1).slice(a, b - a))) if classes else []
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number + np.arange(len(found))),
                         batch.column(0).take(pa.array([a + i for i, _, _ in found], pa.int64())),
                         pa.array([W.as_signed(x) for _, x, _ in found], pa.list_(pa.int64())),
                         pa.array([W.as_signed(x) for _, _, x in found], pa.list_(pa.int64()))], names=names)
                    number += len(found)

    long_list = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", key_field.dataType),
                           T.StructField("marks", long_list), T.StructField("hits", long_list)])
    docs = cut_lineage(src.select("key", "_text").mapInArrow(run, schema))
    pairs = (docs.select("row", F.explode("marks").alias("mark")).join(index, "mark").select("row", "item").distinct())
    both = (pairs.join(docs.select("row", "key", "hits"), "row")
            .join(table.select(F.col("row").alias("item"), "item_id", "shingles"), "item"))
    shared = both.select("key", "item_id", F.size(F.array_intersect("hits", "shingles")).cast("long").alias("n_shared"),
                         F.size("shingles").cast("long").alias("n_item"))
    return shared.where(100 * F.col("n_shared") >= percent * F.col("n_item"))


def matches(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, hashes: int = 64,
            lower: bool = True, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of every item found in a document."""
    src = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("_text"))
    found = _candidates(src, items, k, percent, hashes, lower, item_col, item_text_col)
    return found.select(F.col("key").alias("doc_id"), "item_id", "n_shared", "n_item",
                        (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _text_key(text: Column) -> Column:
    """A text's name: two hashes and its length."""
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), F.length(text).alias("n"))


def clean_rows(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, hashes: int = 64,
               lower: bool = True, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns as they are."""
    text = F.col(f"`{text_col}`")
    src = docs.select(_text_key(text).alias("key"), text.alias("_text"))
    found = _candidates(src, items, k, percent, hashes, lower, item_col, item_text_col)
    gone = cut_lineage(found.select(F.col("key").alias("_found")).distinct())
    return docs.join(gone, _text_key(text) == F.col("_found"), "left_anti")


# Items of fewer than five words are one shingle of all of them; texts give runs of as many words as any item asks for.
ORACLE = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
           UNION ALL
           SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
l AS (SELECT DISTINCT least(5, len(ws)) AS q FROM w WHERE side = 'b' AND len(ws) > 0),
p AS (SELECT side, id, ws, q, unnest(range(1, len(ws) - q + 2)) AS i FROM w JOIN l
      ON len(ws) >= q AND (side = 'd' OR q = least(5, len(ws)))),
s AS (SELECT DISTINCT side, id, q, array_to_string(ws[i:i + q - 1], ' ') AS g FROM p),
n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'b' GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
      FROM s d JOIN s b ON d.g = b.g AND d.q = b.q AND d.side = 'd' AND b.side = 'b' GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment
FROM m JOIN n ON n.id = m.item_id WHERE 100 * n_shared >= 80 * n_item
"""
