"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each its number of distinct word shingles, a 128-bit fingerprint of the set
   and its signature: one byte of each of 512 min-hashes. Eight min-hashes make a band.
2. Texts with equal sets are one class, represented by its smallest id (grouped map-side first).
3. Representatives that share a band are candidates. A bucket is never expanded into all its pairs: hubs are
   tried first, classes linked so far are contracted, and only pairs of different components that still
   share a bucket are tested, each pair in the first bucket it shares.
4. A candidate is judged in batches of its signature, inside the join that finds it: after each batch it is
   dropped if the posterior probability of a similarity at the threshold or above is under ``miss`` (uniform
   prior), so a group of texts that are alike, but not alike enough, does not emit its pairs.
5. Survivors are verified exactly on their full shingle sets; links give connected components.

A link of similarity 0.8 is lost if no band agrees (8e-6; 2e-8 at 0.85) or by the chosen ``miss`` probability.

Edge cases: a text with fewer words than a shingle is one shingle of all its words; null and empty texts
have no shingle and are linked with nothing; a null id is never linked, has a null component and is kept;
repeated rows get one result row each; extra columns are not carried by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm import words as W
from threadlens.llm.components import components
from threadlens.session import cut_lineage

BATCH = 256
HUB_ROUNDS = 2
SLICE_BYTES = 1 << 20     # keeps a worker under about 100 MB
_CACHE_RUN = 1 << 15


class Hasher:
    """``n`` hash permutations of 64-bit keys: xor with a constant, then an odd multiplier."""

    def __init__(self, n: int, seed: int = 1):
        base = np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)
        self.flip = W.mix64(base[:n] * np.uint64(0x9E3779B97F4A7C15))
        self.mult = W.mix64(base[n:] * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.n = n

    def minima(self, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Min-hashes (segments, n) of the non-empty segments of ``keys`` that begin at ``starts``."""
        out = np.empty((len(starts), self.n), dtype=np.uint64)
        if not len(starts):
            return out
        bounds = np.append(starts, len(keys))
        at = 0
        while at < len(starts):      # runs that stay in the processor's cache
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _CACHE_RUN, side="right")) - 1)
            part = keys[bounds[at]:bounds[to]]
            cut = starts[at:to] - bounds[at]
            buf = np.empty_like(part)
            for j in range(self.n):
                np.bitwise_xor(part, self.flip[j], out=buf)
                np.multiply(buf, self.mult[j], out=buf)
                out[at:to, j] = np.minimum.reduceat(buf, cut)
            at = to
        return out


def bit_planes(minima: np.ndarray) -> np.ndarray:
    """One byte of each min-hash, eight longs of one bit each for every 64 min-hashes."""
    byte = (minima >> np.uint64(56)).astype(np.uint8) ^ (minima >> np.uint64(7)).astype(np.uint8)
    n, m = byte.shape
    bits = np.unpackbits(byte.reshape(n, m // 64, 64, 1), axis=3).transpose(0, 1, 3, 2)
    return np.packbits(np.ascontiguousarray(bits), axis=3).reshape(n, m // 8, 8).view(np.int64).reshape(n, m // 8)


def band_codes(minima: np.ndarray, rows: int = 8) -> np.ndarray:
    """A 32-bit code of every ``rows`` min-hashes."""
    key = np.zeros((len(minima), minima.shape[1] // rows), dtype=np.uint64)
    for r in range(rows):
        key = W.mix64(key + minima[:, r::rows])
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def shingle_sets(column: pa.Array, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their bounds."""
    w = W.split_words(column)
    g, first = W.ngrams(w, w.hashes(lower=lower), k)
    sets, sizes = [], np.zeros(len(first) - 1, dtype=np.int64)
    for i in np.flatnonzero(np.diff(first)):
        s = np.sort(g[first[i]:first[i + 1]])
        if len(s) > 1:
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        sets.append(s)
        sizes[i] = len(s)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def signatures(docs: DataFrame, k: int = 4, lower: bool = True, hashes: int = 512, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, k1, k2, sig, bands`` of every row; nulls where a text has no shingle.

    ``sig``: one byte of each of ``hashes`` min-hashes, by bit planes: for every 64 min-hashes eight longs, the
    j-th with bit j of all 64.  ``bands``: a 32-bit code of every eight min-hashes.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    hasher = Hasher(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(1), SLICE_BYTES):
                flat, first = shingle_sets(batch.column(1).slice(a, b - a), k, lower)
                size = np.diff(first)
                some = size > 0
                at = first[:-1][some]
                low = hasher.minima(flat, at)
                planes, codes = bit_planes(low), band_codes(low)
                one = np.zeros(b - a, dtype=np.uint64)
                two = np.zeros(b - a, dtype=np.uint64)
                if len(at):
                    one[some] = np.add.reduceat(W.mix64(flat), at)
                    two[some] = np.add.reduceat(W.mix64(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                row = np.cumsum(some) - 1
                none = ~some
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size),
                     pa.array(W.as_signed(one), mask=none), pa.array(W.as_signed(two), mask=none),
                     pa.array([planes[r] if s else None for r, s in zip(row, some)], pa.list_(pa.int64())),
                     pa.array([codes[r] if s else None for r, s in zip(row, some)], pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"])

    return src.mapInArrow(run, f"doc_id {id_type}, n_shingles long, k1 long, k2 long, sig array<long>, "
                               "bands array<int>")


def posterior(matches: int, trials: int, threshold: float) -> float:
    """P(similarity >= threshold | matches of trials agree), uniform prior."""
    n = trials + 1
    return math.fsum(math.comb(n, i) * threshold ** i * (1 - threshold) ** (n - i) for i in range(matches + 1))


def least_matches(total: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """After each batch: (hashes compared, fewest agreeing ones for which a pair goes on)."""
    out = []
    for n in [*range(BATCH, total, BATCH), total]:
        m = 0
        while posterior(m, n, threshold) < miss:
            m += 1
        out.append((n, m))
    return out


def passes_batches(x: Column, y: Column, hashes: int, threshold: float, miss: float) -> Column:
    """The sequential test as a condition on two signatures: batch by batch, the first failure ends it."""
    test, hits, at = F.lit(True), F.lit(0), 0
    for upto, least in least_matches(hashes, threshold, miss):
        for group in range(at // 64, upto // 64):
            hits = hits + _equal_bytes([x[8 * group + j] for j in range(8)], [y[8 * group + j] for j in range(8)])
        test, at = test & (hits >= least), upto
    return test


def _equal_bytes(x: list[Column], y: list[Column]) -> Column:
    """How many of 64 bytes, given by their eight bit planes, are equal."""
    differs = reduce(lambda a, b: a.bitwiseOR(b), (a.bitwiseXOR(b) for a, b in zip(x, y)))
    return 64 - F.bit_count(differs)


def _full_sets(docs: DataFrame, ids: DataFrame, k: int, lower: bool) -> DataFrame:
    """``doc_id, items`` (sorted shingle hashes, packed) of the texts with the given ids."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(1), SLICE_BYTES):
                flat, first = shingle_sets(batch.column(1).slice(a, b - a), k, lower)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array([flat[s:e].tobytes() for s, e in zip(first[:-1], first[1:])], pa.binary())],
                    names=["doc_id", "items"])

    return (docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")
            .mapInArrow(run, f"doc_id {id_type}, items binary"))


def _exact(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets meet the threshold: 100 * |a & b| >= percent * |a | b|."""
    id_type = dict(items.dtypes)["doc_id"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (p, q))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in (0, 1)], names=["a", "b"])

    both = (pairs.join(items.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
            .join(items.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(check, f"a {id_type}, b {id_type}")


def near_duplicates(docs: DataFrame, k: int = 4, lower: bool = True, percent: int = 80, hashes: int = 512,
                    miss: float = 1e-5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    all_sigs = cut_lineage(signatures(docs, k, lower, hashes))
    sets = ["n_shingles", "k1", "k2"]
    some = all_sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(some.groupBy(*sets).agg(F.min("doc_id").alias("rep")))
    reps = cut_lineage(some.join(classes.select(F.col("rep").alias("doc_id"), *sets), ["doc_id", *sets], "left_semi")
                       .select("doc_id", F.col("n_shingles").alias("n"), "sig", "bands"))
    comp = linked_components(docs, reps, hashes, k, lower, percent, miss)
    named = (classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
             .select(*sets, F.coalesce("component", "rep").alias("component_id")))
    named = cut_lineage(named)
    linked = all_sigs.select("doc_id", *sets).join(named, sets, "left")
    # A row without shingles, or whose id is null, stands alone.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (linked.withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id",
                    (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept")))


def distinct_rows(docs: DataFrame, k: int = 5, lower: bool = True, percent: int = 80, id_col: str = "doc_id",
                  text_col: str = "text", **search: object) -> DataFrame:
    """The rows of ``docs`` that stay when one text of each component does: the smallest id.

    Rows without shingles or with a null id stay. Where ids repeat, a row is known by its id and its text, so
    that only rows of the same text, or of linked ones, go.
    """
    def repeated(rows: DataFrame, key: str) -> DataFrame:
        return cut_lineage(rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))

    rows, key = docs, id_col
    if not repeated(docs, id_col).isEmpty():
        key = "_row_key"
        while key in docs.columns:
            key += "_"
        rows = docs.withColumn(key, F.when(F.col(id_col).isNotNull(), F.struct(
            F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))))
    found = near_duplicates(rows, k, lower, percent, id_col=key, text_col=text_col, **search)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    rest = rows.join(gone.hint("merge"), key, "left_anti").select(rows.columns)
    if key == id_col:
        return rest
    twice = repeated(rows, key)
    return rest.join(twice, key, "left_anti").select(rows.columns).unionByName(
        rest.join(twice, key, "left_semi").select(rows.columns).dropDuplicates([key])).drop(key)


def linked_components(docs: DataFrame, reps: DataFrame, hashes: int, k: int, lower: bool, percent: int,
                      miss: float) -> DataFrame:
    """``id, component`` of all representatives (``doc_id, n, sig, bands``) linked with another one."""
    id_type = dict(reps.dtypes)["doc_id"]
    band = reps.select("doc_id", F.posexplode("bands").alias("band", "code")).select(
        "doc_id", F.col("band").cast("short").alias("band"), F.xxhash64("band", "code").alias("key"))
    shared = cut_lineage(band.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"))
    member = cut_lineage(band.join(shared, "key"))
    one, two = (reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
                for x in ("a", "b"))
    similar = ((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
               & passes_batches(F.col("sig_a"), F.col("sig_b"), hashes, percent / 100, miss))
    items = None
    comp = docs.sparkSession.createDataFrame([], f"id {id_type}, component {id_type}")
    for turn in range(HUB_ROUNDS + 1):
        live = member.withColumn("c", F.col("doc_id"))
        if turn:
            live = (member.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
                    .withColumn("c", F.coalesce("component", "doc_id")).drop("component"))
            mixed = live.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
            live = cut_lineage(live.join(cut_lineage(mixed.select("key")), "key"))
        if turn < HUB_ROUNDS:
            # One hub a bucket, another one each turn, against all members of other components.
            order = F.col("doc_id") if turn == 0 else F.xxhash64(F.lit(turn), "c", "doc_id")
            hubs = cut_lineage(live.groupBy("key").agg(F.min_by(F.struct(F.col("doc_id").alias("hub"), F.col("c").alias("hub_c")),
                                                                order).alias("h")).select("key", "h.*"))
            tried = (live.join(hubs, "key").where("c != hub_c")
                     .select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct())
            pairs = tried.join(one, "a").join(two, "b").where(similar).select("a", "b")
        else:
            # What is left: members of different components that share a bucket, in the first one they share.
            side = cut_lineage(live.select("key", "doc_id", "band", "c").join(reps, "doc_id"))
            left, right = (side.select("key", F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"),
                                       F.col("c").alias(f"c_{x}"), F.col("band").alias(f"band_{x}"),
                                       F.col("bands").alias(f"bands_{x}")) for x in ("a", "b"))
            first_shared = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) == F.col("band_a") + 1
            pairs = (left.join(right, "key").drop("key")
                     .where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & similar & first_shared)
                     .select("a", "b").distinct())
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            continue
        if items is None:
            items = cut_lineage(_full_sets(docs, member.select("doc_id").distinct(), k, lower))
        found = cut_lineage(_exact(pairs, items, percent))
        if not found.isEmpty():
            old = comp.select(F.col("id").alias("a"), F.col("component").alias("b"))
            comp = cut_lineage(components(old.unionByName(found)))
    return comp
