"""Text features in sparse COO form: term counts, vocabularies, exact TF-IDF.

A document is any key (a post, a (thread, user) pair, a document id).  Term
occurrences are exploded per source row and counted per (document, term), so
a document's text is never concatenated into one value, and every step is a
partial aggregate or a join on a term or document key.
"""

from __future__ import annotations

from typing import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlens.functions import text as T
from threadlens.session import cut_lineage, deal

MAX_VOCABULARY = 2_000_000      # terms that are sent to the workers as strings
MAX_HASHED = 24_000_000         # terms of two documents or more that are sent to the workers as hash and number, 12 bytes each
MAX_REPEATED = 2_000_000        # keys of several rows that are sent to the rows
DOCUMENT_ROWS = 8_192           # rows a task gathers by document

def term_occurrences(df: DataFrame, keys: Sequence[str], text: str, stop_words: Iterable[str] | None = None
                     ) -> DataFrame:
    """One row per term occurrence ``(keys..., term)`` (T12 terms).

    Stop words are removed after the explode with an ``isin`` filter, which
    Catalyst plans as a hash-set lookup (``InSet``) inside the scan's codegen stage.
    """
    occ = df.select(*keys, F.explode(T.terms(text)).alias("term"))
    if stop_words:
        occ = occ.where(~F.col("term").isin(*sorted(set(stop_words))))
    return occ


def term_counts(occ: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., term, tf)``.

    The not-null filters are stated up front: the later joins on term and
    document keys would otherwise infer them into only some branches, and the
    branches would stop sharing (reusing) this one aggregation exchange.
    """
    cond = F.col("term").isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return occ.where(cond).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(term, df, cnt)``: documents containing the term and its corpus count."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cnt"))


def _number_of(documents: DataFrame, keys: Sequence[str]):
    """How many distinct keys there are, as a scalar subquery."""
    return documents.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()


def vocabulary(tf: DataFrame, keys: Sequence[str], min_df: int = 1, max_df: float = 1.0,
               max_features: int | None = None, documents: DataFrame | None = None) -> DataFrame:
    """M2: terms with ``df >= min_df`` and ``df <= max_df * N``, then the ``max_features`` largest
    corpus counts (ties by term); ``term_index`` is the alphabetical position (0-based).

    N counts the rows of ``documents`` (distinct keys), those without a term included.
    """
    n_docs = _number_of(tf if documents is None else documents, keys)
    d = document_frequency(tf, keys).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
    if max_features is not None:
        d = d.orderBy(F.desc("cnt"), "term").limit(max_features)
        w = Window.orderBy("term")  # at most max_features rows
        return d.select("term", "df", "cnt", (F.row_number().over(w) - 1).alias("term_index"))
    from threadlens.operators.relational import dense_index

    return dense_index(d.select("term", "df", "cnt"), ["term"], "term_index")


def restrict(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep only vocabulary terms (the join follows the vocabulary's measured size)."""
    v = vocab.select("term", "term_index")
    return tf.join(v, "term")


def tfidf(tf: DataFrame, keys: Sequence[str], idf_from: DataFrame | None = None, materialize: bool = True,
          documents: DataFrame | None = None) -> DataFrame:
    """M1: ``w = tf * (ln((1 + N) / (1 + df)) + 1)`` divided by the document's L2 norm.

    ``idf_from`` (same shape as ``tf``) fits the idf on another corpus; terms it
    lacks are dropped.  ``documents`` holds the keys of all documents the idf is
    fitted on, those without a term included (N counts them).  Output ``(keys..., term, tf, weight)`` rounded to 6 places.
    ``tf`` feeds three branches (document count, document frequency, weights),
    so by default it is written once to the shared checkpoint folder instead
    of re-tokenizing the corpus per branch.
    """
    if materialize:
        tf = cut_lineage(tf)
        if idf_from is not None:
            idf_from = cut_lineage(idf_from)
    fit = tf if idf_from is None else idf_from
    kfit = keys if idf_from is None else [c for c in fit.columns if c not in ("term", "tf", "term_index")]
    n_docs = _number_of(fit if documents is None else documents, kfit)
    idf = document_frequency(fit, kfit).select(
        "term", (F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + 1).alias("idf"))
    # idf comes out of a shuffle, so AQE sees its real size and turns this into a
    # broadcast join only when it is small; no extra pass over the corpus to count it.
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    # One shuffle on the document: its squared weights are summed inside that partitioning.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return w.select(*keys, "term", "tf", F.round(F.col("w") / norm, 6).alias("weight"))


def document_rows(df: DataFrame, keys: Sequence[str], seen: DataFrame) -> DataFrame:
    """The rows of ``df`` with a key, those of a document next to each other. ``seen``: ``(keys..., n)``, rows of each key.

    A row that is a document of its own stays where it is; only the rows of repeated keys are dealt by key.
    """
    there = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    again = seen.where(there).where("n > 1")
    size = again.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    rows = df.where(there)
    if not size["keys"]:
        return rows
    if size["keys"] > MAX_REPEATED:
        n_rows = seen.where(there).agg(F.sum("n")).first()[0]
        return deal(rows, list(keys), n_rows, DOCUMENT_ROWS).sortWithinPartitions(*keys)
    again = F.broadcast(again.select(*keys))
    several = deal(rows.join(again, list(keys), "left_semi"), list(keys), size["rows"], DOCUMENT_ROWS)
    return rows.join(again, list(keys), "left_anti").unionByName(several.sortWithinPartitions(*keys))


def _documents(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple]:
    """Counts of the terms of whole documents: ``(keys, terms, at, code, tf)``, where ``at`` and ``code`` say which document
    and which term. Equal keys follow each other; the last document of a batch is held, as counts, until it has ended."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, lists = batch.columns[:n_keys], batch.column(n_keys)
        size, terms = pc.fill_null(lists.value_lengths(), 0).to_numpy(), lists.flatten()
        n = np.ones(len(terms), dtype=np.int64)
        if held is not None:
            keys = [pa.concat_arrays([h, k]) for h, k in zip(held[0], keys)]
            size, n = np.append(len(held[1]), size), np.append(held[2], n)
            terms = pa.concat_arrays([held[1], terms])
        new = np.zeros(len(size), dtype=bool)
        for k in keys:
            new[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
        doc = np.cumsum(new)
        new[0] = True
        coded = terms.dictionary_encode()
        width = max(len(coded.dictionary), 1)
        cell, back = np.unique(np.repeat(doc, size) * width + coded.indices.to_numpy(), return_inverse=True)
        tf = np.bincount(back, weights=n, minlength=len(cell)).astype(np.int64)
        at, code = cell // width, cell % width
        last = np.searchsorted(at, doc[-1])
        held = ([k[-1:] for k in keys], coded.dictionary.take(pa.array(code[last:])), tf[last:])
        first = pa.array(np.flatnonzero(new)[:-1])
        yield [k.take(first) for k in keys], coded.dictionary, at[:last], code[:last], tf[:last]
    if held is not None:
        yield held[0], held[1], np.zeros(len(held[2]), dtype=np.int64), np.arange(len(held[2])), held[2]


def _types(df: DataFrame, names: Sequence[str]) -> list[str]:
    types = dict(df.dtypes)
    return [f"`{k}` {types[k]}" for k in names]


def counted_terms(df: DataFrame, keys: Sequence[str], text: str, stop_words: Iterable[str] | None = None) -> DataFrame:
    """``term_counts(term_occurrences(df))``, counted where a document lies: no row of (document, term) is shuffled."""
    names = list(keys)
    seen = cut_lineage(df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    lists = document_rows(df.select(*names, text), names, seen).select(*names, T.terms(text, stop_words).alias("terms"))

    def rows(batches):
        for key, terms, at, code, tf in _documents(batches, len(names)):
            row = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(k.take(row) for k in key), terms.take(pa.array(code)), pa.array(tf)],
                                             names=[*names, "term", "tf"])

    return lists.mapInArrow(rows, ", ".join([*_types(df, names), "term string", "tf long"]))


def list_frequencies(lists: DataFrame, terms_col: str) -> DataFrame:
    """``(term, df, cnt)`` of a column of term lists, a document a row."""
    def run(batches):
        for _, terms, _, code, tf in _documents(batches, 1):
            yield pa.RecordBatch.from_arrays([terms, *(pa.array(np.bincount(code, weights=w, minlength=len(terms)).astype(np.int64))
                                                       for w in (None, tf))], names=["term", "df", "cnt"])

    rows = lists.select(F.monotonically_increasing_id().alias("row"), terms_col)
    return (rows.mapInArrow(run, "term string, df long, cnt long").where("term IS NOT NULL")
            .groupBy("term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt")))


def term_hashes(terms: pa.Array, bits: int = 64) -> np.ndarray:
    """64-bit hashes of terms, the same in every process; ``bits`` keeps fewer of them."""
    h = pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False)
    return h & np.uint64((1 << bits) - 1)


def tfidf_texts(df: DataFrame, keys: Sequence[str], text: str, stop_words: Iterable[str] | None = None,
                hash_bits: int = 64) -> DataFrame:
    """M1 of texts: ``tfidf(term_counts(term_occurrences(df)))`` with all rows of ``df`` as documents, and no row of
    (document, term) shuffled or written.

    Terms are counted where their document lies (``document_rows``), once for the document frequencies and once for
    the weights. The document frequencies go to the workers by the hash of their term, while at most ``MAX_HASHED`` terms
    are in two documents or more (any other is in one document); terms that share a hash go as they are. Larger
    vocabularies are joined by a shuffle.
    """
    names = list(keys)
    seen = cut_lineage(df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), drop_shuffles=True)
    n_docs = seen.count()
    lists = document_rows(df.select(*names, text), names, seen).select(*names, T.terms(text, stop_words).alias("terms"))

    def frequencies(batches):
        for _, terms, _, code, _ in _documents(batches, len(names)):
            df_ = np.bincount(code, minlength=len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term_hashes(terms, hash_bits).view(np.int64)), terms, pa.array(df_)],
                                             names=["h", "term", "df"])

    counts = cut_lineage(lists.mapInArrow(frequencies, "h long, term string, df long").groupBy("h", "term")
                         .agg(F.sum("df").alias("df")), drop_shuffles=True)
    common = counts.where("df > 1")
    if common.count() > MAX_HASHED:
        return tfidf(term_counts(term_occurrences(df, names, text, stop_words), names), names, documents=df)
    shared = counts.join(counts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "h", "left_semi")
    clash = shared.select("term", "df").toArrow()
    number = F.col("df").cast("int" if n_docs < 2 ** 31 else "long")
    table = common.select("h", number.alias("df")).orderBy("h").toArrow().combine_chunks()
    sent = df.sparkSession.sparkContext.broadcast((
        table["h"].to_numpy(), table["df"].to_numpy(), clash["term"].combine_chunks(), clash["df"].to_numpy()))

    def weights(batches):
        held, numbers, alike, alike_df = sent.value
        for key, terms, at, code, tf in _documents(batches, len(names)):
            if not len(at):
                continue
            df_ = np.ones(len(terms), dtype=np.int64)
            if len(held):
                h = term_hashes(terms, hash_bits).view(np.int64)
                place = np.minimum(np.searchsorted(held, h), len(held) - 1)
                df_ = np.where(held[place] == h, numbers[place], df_)
            if len(alike):
                place = pc.index_in(terms, value_set=alike)
                known = place.is_valid().to_numpy(zero_copy_only=False)
                df_[known] = alike_df[place.drop_null().to_numpy()]
            w = tf * (np.log((1 + n_docs) / (1 + df_)) + 1)[code]
            norm = np.sqrt(np.bincount(at, weights=w * w))
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(k.take(rows) for k in key), terms.take(pa.array(code)), pa.array(tf),
                                              pa.array(w / norm[at])], names=[*names, "term", "tf", "weight"])

    schema = ", ".join([*_types(df, names), "term string", "tf long", "weight double"])
    return lists.mapInArrow(weights, schema).withColumn("weight", F.round("weight", 6))


def top_terms(weights: DataFrame, group: str, n: int, weight: str = "weight", term: str = "term") -> DataFrame:
    """Top ``n`` terms per group (topic) by weight, ties by term."""
    w = Window.partitionBy(group).orderBy(F.desc(weight), F.asc(term))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def negation_terms(df: DataFrame, key: str, text: str = "clean_text") -> DataFrame:
    """M4 input: negation-marked tokens (T10) of each text, then lower-case word terms of each token."""
    toks = df.where(F.col(text).isNotNull()).select(key, T.as_words(text).alias("tokens"))
    marked = T.mark_negation_rows(toks, key, "tokens", "tok")
    return marked.select(key, F.explode(F.regexp_extract_all(F.lower("tok"), F.lit(T.TERM_PATTERN), 0)).alias("term"))
