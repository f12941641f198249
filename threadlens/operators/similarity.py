"""The ``k`` most similar documents of each query, exactly, without pairing queries and documents.

Documents stay where they are: one row per document with its weights on query terms. Each task cuts its rows into
chunks and indexes a chunk by term. The postings of a term stand in document order in blocks with the largest weight
of each (block maxima). The documents of the largest weights of a query's strongest terms (impact order) are scored
first and give a score that ``k`` documents reach. Terms whose bounds together stay below that score are not read for
candidates (max-score), nor are blocks that cannot reach it; candidates are dropped as soon as what is left cannot
lift them. Bounds are the smaller of the sum of largest weights and the product of lengths (Cauchy-Schwarz). A task hands on ``k`` rows per query, so the exchange that follows holds queries, not pairs.

Queries are sent to the tasks in blocks of at most ``block_terms`` weights. All weights are positive. Scores are
rounded to six places before they are ranked, ties go to the smaller document id; a margin of rounding is kept in all
bounds, so rows and order are those of scoring every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

BLOCK = 64
MARGIN = 2e-6       # rounding of two scores, and the sums' own
CHUNK_WEIGHTS = 1_000_000


class Postings:
    """Postings of a chunk of documents: by term, then document, with block maxima."""

    def __init__(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int):
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        size = np.diff(self.start)
        blocks = -(-size // BLOCK)
        self.block = np.concatenate(([0], np.cumsum(blocks)))
        begin = np.repeat(self.start[:-1], blocks) + BLOCK * (np.arange(self.block[-1]) - np.repeat(self.block[:-1], blocks))
        self.begin = begin
        self.maxima = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.top = np.zeros(n_terms)
        some = size > 0
        if some.any():
            self.top[some] = np.maximum.reduceat(self.maxima, self.block[:-1][some])
        # What a document has on query terms at all: sum of squares, and the largest of the chunk.
        self.mass = np.bincount(doc, weight * weight, len(first) - 1)
        self.most = float(np.sqrt(self.mass.max(initial=0.0)))
        self._strongest: dict[tuple[int, int], np.ndarray] = {}

    def strongest(self, term: int, n: int) -> np.ndarray:
        """The documents of the ``n`` largest weights of a term (its impact order, as far as it is asked for)."""
        if (term, n) not in self._strongest:
            lo, hi = self.start[term], self.start[term + 1]
            at = np.arange(lo, hi) if hi - lo <= n else lo + np.argpartition(self.weight[lo:hi], hi - lo - n)[hi - lo - n:]
            self._strongest[term, n] = self.doc[at]
        return self._strongest[term, n]

    def scores(self, terms: np.ndarray, weights: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Full scores of the given documents (sorted)."""
        out = np.zeros(len(doc))
        for t, w in zip(terms, weights):
            lo, hi = self.start[t], self.start[t + 1]
            at = np.minimum(lo + np.searchsorted(self.doc[lo:hi], doc), hi - 1)
            hit = self.doc[at] == doc
            out[hit] += w * self.weight[at[hit]]
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores that may be among the best ``k`` and beat ``floor``; how many were scored."""
        live = self.top[terms] > 0
        terms, weights = terms[live], weights[live]
        none = np.zeros(0, dtype=np.int64), np.zeros(0), 0
        if not len(terms):
            return none
        bound = weights * self.top[terms]
        order = np.argsort(bound, kind="stable")
        terms, weights, bound = terms[order], weights[order], bound[order]
        # A score that ``k`` documents reach: that of the strongest ones of the terms that can give most.
        first = np.unique(np.concatenate([self.strongest(int(t), 2 * k + 8) for t in terms[-6:]]))
        if len(first) >= k:
            known = self.scores(terms, weights, first)
            floor = max(floor, float(np.partition(known, len(known) - k)[len(known) - k]))
        least = floor - MARGIN
        # What terms up to this one can give together: by their largest weights, and by lengths (Cauchy-Schwarz).
        square = np.cumsum(weights * weights)
        below = np.minimum(np.cumsum(bound), np.sqrt(square) * self.most)
        if below[-1] < least:
            return none
        skip = int(np.searchsorted(below, least, side="left"))      # these alone cannot reach it
        docs, parts, total = [], [], float(bound.sum())
        for t, w, b in zip(terms[skip:], weights[skip:], bound[skip:]):
            lo, hi = self.block[t], self.block[t + 1]
            rest = float(np.sqrt(max(0.0, square[-1] - w * w)))
            good = np.flatnonzero(w * self.maxima[lo:hi] + min(total - b, rest * self.most) >= least) + lo
            if not len(good):
                continue
            end = np.minimum(self.begin[good] + BLOCK, self.start[t + 1])
            at = np.repeat(self.begin[good], end - self.begin[good]) + _runs(end - self.begin[good])
            x = self.weight[at]
            at = at[w * x + rest * np.sqrt(np.maximum(0.0, self.mass[self.doc[at]] - x * x)) >= least]
            docs.append(self.doc[at])
            parts.append(w * self.weight[at])
        if not docs:
            return none
        doc, inv = np.unique(np.concatenate(docs), return_inverse=True)
        if not len(doc):
            return none
        score = np.bincount(inv, np.concatenate(parts), len(doc))
        scored = len(doc)
        for i in range(skip - 1, -1, -1):
            if len(doc) > k:
                least = max(least, float(np.partition(score, len(score) - k)[len(score) - k]) - MARGIN)
            keep = score + np.minimum(below[i], np.sqrt(square[i] * self.mass[doc])) >= least
            doc, score = doc[keep], score[keep]
            own = self.doc[self.start[terms[i]]:self.start[terms[i] + 1]]
            at = np.minimum(np.searchsorted(own, doc), len(own) - 1)
            hit = own[at] == doc
            score[hit] += weights[i] * self.weight[self.start[terms[i]] + at[hit]]
        return doc, score, scored


def _runs(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class QueryBlock:
    """Queries as term numbers and weights."""

    def __init__(self, rows: list[tuple[object, list[str], list[float]]]):
        self.ids = [r[0] for r in rows]
        self.terms = sorted({t for _, ts, _ in rows for t in ts})
        code = {t: i for i, t in enumerate(self.terms)}
        self.queries = [(np.array([code[t] for t in ts], dtype=np.int64), np.array(ws)) for _, ts, ws in rows]


def query_blocks(queries: DataFrame, qkey: str, block_terms: int) -> Iterator[QueryBlock]:
    lists = queries.groupBy(qkey).agg(F.collect_list("term").alias("t"), F.collect_list("weight").alias("w"))
    held, size = [], 0
    for r in lists.toLocalIterator():
        if held and size + len(r["t"]) > block_terms:
            yield QueryBlock(held)
            held, size = [], 0
        held.append((r[qkey], r["t"], r["w"]))
        size += len(r["t"])
    if held:
        yield QueryBlock(held)


def _best_of_tasks(documents: DataFrame, block: QueryBlock, qtype: T.DataType, ckey: str, k: int) -> DataFrame:
    """``q, d, cosine, scored``: the best ``k`` of each chunk and query; ``scored`` stands on the first of them."""
    schema = T.StructType([T.StructField("q", qtype), T.StructField("d", documents.schema[ckey].dataType),
                           T.StructField("cosine", T.DoubleType()), T.StructField("scored", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def search(first: list, ids: list, terms: list, weights: list, floors: np.ndarray) -> pa.RecordBatch:
        index = Postings(np.array(first), np.concatenate(terms), np.concatenate(weights), len(block.terms))
        names = pd.Series(ids)
        rank = names.rank(method="first").to_numpy()
        out: list[list] = [[], [], [], []]
        for i, (t, w) in enumerate(block.queries):
            doc, score, scored = index.search(t, w, k, floors[i])
            score = np.round(score, 6)
            best = np.lexsort((rank[doc], -score))[:k]
            if len(best) == k:
                floors[i] = max(floors[i], float(score[best[-1]]))
            for j, b in enumerate(best):
                for c, x in zip(out, (block.ids[i], ids[doc[b]], float(score[b]), scored if j == 0 else 0)):
                    c.append(x)
            if scored and not len(best):
                for c, x in zip(out, (block.ids[i], None, None, scored)):
                    c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["q", "d", "cosine", "scored"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = np.zeros(len(block.queries))
        first, ids, terms, weights = [0], [], [], []
        for batch in batches:
            for name, t, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                ids.append(name)
                terms.append(t.values.to_numpy().astype(np.int64))
                weights.append(w.values.to_numpy())
                first.append(first[-1] + len(terms[-1]))
                if first[-1] >= CHUNK_WEIGHTS:
                    yield search(first, ids, terms, weights, floors)
                    first, ids, terms, weights = [0], [], [], []
        if ids:
            yield search(first, ids, terms, weights, floors)

    return documents.mapInArrow(run, schema)


def best_matches(queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str, k: int, block_terms: int = 500_000) -> DataFrame:
    """``q, d, cosine, scored`` before the last merge: some ``k`` rows per task and query."""
    spark = queries.sparkSession
    qtype = queries.schema[qkey].dataType
    out = None
    for block in query_blocks(queries.select(qkey, "term", "weight"), qkey, block_terms):
        codes = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": block.terms, "code": range(len(block.terms))}),
                                                  "term string, code long"))     # at most ``block_terms`` rows
        # The weights are dealt out by document already where they come from ``tfidf``.
        lists = (corpus.select(ckey, "term", "weight").join(codes, "term").groupBy(ckey)
                 .agg(F.collect_list(F.struct("code", "weight")).alias("l"))
                 .select(ckey, F.col("l.code").alias("codes"), F.col("l.weight").alias("weights")))
        part = _best_of_tasks(lists, block, qtype, ckey, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        ctype = corpus.schema[ckey].dataType
        return spark.createDataFrame([], T.StructType([
            T.StructField("q", qtype), T.StructField("d", ctype), T.StructField("cosine", T.DoubleType()),
            T.StructField("scored", T.LongType())]))
    return out


def similar_documents(queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str, k: int,
                      block_terms: int = 500_000) -> DataFrame:
    """``qkey, ckey, cosine, rank`` of the top ``k`` documents by cosine for each query (exact).

    Both sides are L2-normalised TF-IDF rows ``(key, term, weight)``.
    """
    found = best_matches(queries, corpus, qkey, ckey, k, block_terms).where("d IS NOT NULL")
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), F.asc("d"))
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(qkey), F.col("d").alias(ckey), "cosine", "rank")


def scored_pairs(queries: DataFrame, corpus: DataFrame, qkey: str, ckey: str, k: int) -> DataFrame:
    """How many documents each query scored: ``qkey, scored``."""
    return (best_matches(queries, corpus, qkey, ckey, k).groupBy("q").agg(F.sum("scored").alias("scored"))
            .withColumnRenamed("q", qkey))
