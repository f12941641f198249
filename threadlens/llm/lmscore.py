"""Cross-entropy difference: how much better a target language model predicts a text than a background one.

Both models are interpolated bigram models over all words of the corpus, with exact counts of every word and
of every (previous, word) pair (words stand as 64-bit hashes).  Counts are taken over all texts (background,
scaled to the target's size so that the same smoothing weighs alike) and over all target texts; a text's own
counts are left out when it is scored.

Counts never meet in one place.  Texts are dealt into slices of a few MB by their id.  A slice deals the distinct
words and pairs it holds, as one 64-bit key each with its own counts of them, into buckets by ranges of the key; a
bucket sums the counts of all slices and answers each one with the totals of the keys it asked for, in their order and
without the keys.  Then the slices are dealt once more and scored by the answers, so texts are never written, and the
shuffle of a step is deleted before the next one.  A key that very many texts hold is one entry a slice, and the
number of buckets grows with the corpus, so no task grows with it.  Nothing but five sums is gathered in the driver.

``loss difference = H_target - H_background`` in bits per token: lower is closer to the target.

Edge cases: null and empty texts have no token and null scores; without any target text (or any text)
both models fall back to the uniform distribution and differences are those of the background alone;
a null id is scored, but cannot be a target; repeated rows are counted and scored each (all texts of one id are
in one slice); extra columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm import words as W
from threadlens.session import cut_lineage

_START = np.uint64(0)       # stands before a text's first word
BUCKET_BYTES = 16 << 20     # text bytes a bucket answers for


def _pack(values: np.ndarray) -> bytes:
    """Integers of 64 bits, the lowest bytes of all first: counts and gaps of keys have few high ones, which compress."""
    planes = np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.reshape(-1), codec="zstd", asbytes=True)


def _unpack(body: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(body, 8 * n, codec="zstd"), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int64)


class Slice:
    """The tokens of a slice of texts, and its distinct words and pairs in the order of their keys.

    The order depends on the set of texts alone, so that answers need not repeat the keys.
    """

    def __init__(self, column: pa.Array):
        self.w = W.split_words(column)
        word = self.w.hashes(lower=True)
        self.words, self.at = np.unique(word, return_inverse=True)      # word of every token
        self.before = np.empty(len(self.at), dtype=np.int64)
        self.before[1:] = self.at[:-1]              # word before every token, -1 at the start of a text
        starts = self.w.first[:-1][self.w.counts > 0]
        self.before[starts] = -1
        key = np.empty(len(word), dtype=np.uint64)
        key[1:] = word[:-1]
        key[starts] = _START
        self.pairs, self.pair = np.unique(W.mix64(W.mix64(key) + word), return_inverse=True)    # pair of every token

    def requests(self, flag: np.ndarray, buckets: int) -> list[pa.Array]:
        """``bucket, n_words, n_pairs, body``, a row for each bucket that the slice has a key in.

        ``body``: keys (as gaps), counts in targets and counts in all texts, of the words and then of the pairs.
        """
        mine = np.repeat(flag, self.w.counts)
        # A bucket is a range of keys, so keys in order are in the order of their buckets.
        bucket = [((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                  for x in (self.words, self.pairs)]
        used = np.unique(np.concatenate(bucket))
        cuts = [np.append(np.searchsorted(x, used), len(x)) for x in bucket]
        columns = [[W.as_signed(k), *(np.bincount(x, minlength=len(k)) for x in (at[mine], at))]
                   for k, at in ((self.words, self.at), (self.pairs, self.pair))]
        body = []
        for i in range(len(used)):
            parts = []
            for cut, (key, *counts) in zip(cuts, columns):
                here = slice(cut[i], cut[i + 1])
                parts += [np.diff(key[here], prepend=np.int64(0)), *(c[here] for c in counts)]
            body.append(_pack(np.concatenate(parts)))
        return [pa.array(used), *(pa.array(np.diff(x)) for x in cuts), pa.array(body, pa.binary())]


def _flags(ids: pa.Array, targets: pa.Array) -> np.ndarray:
    """Which of ``ids`` are among ``targets``, where no null is."""
    return np.asarray(pc.is_in(ids, value_set=targets).to_pylist(), dtype=bool)


def _requests(texts: DataFrame, targets: DataFrame, id_type: str, buckets: int) -> DataFrame:
    """``slice, bucket, n_words, n_pairs, body``; one more row of each slice has ``sums`` and ``targets`` instead.

    ``sums``: words and texts with a word, of the targets and of all; ``targets``: the ids that are targets.
    """
    names = ["slice", "bucket", "n_words", "n_pairs", "body", "sums", "targets"]
    schema = f"slice long, bucket long, n_words long, n_pairs long, body binary, sums array<long>, targets array<{id_type}>"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        id_kind = left.schema.field("id").type
        out = pa.schema(list(zip(names, [*[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64()), pa.list_(id_kind)])))
        if not left.num_rows:
            return out.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        number = left["slice"][0].as_py()
        ids, wanted = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.nulls(0, id_kind) for c in (left["id"], right["_id"]))
        flag = _flags(ids, wanted)
        x = Slice(pa.concat_arrays(left["text"].chunks))
        asked = x.requests(flag, buckets)
        n, count = len(asked[0]), x.w.counts
        sums = [int(count[flag].sum()), int(count.sum()), int((count[flag] > 0).sum()), int((count > 0).sum())]
        found = ids.filter(pa.array(flag)).unique()
        rows = pa.Table.from_arrays([pa.array(np.full(n, number)), *asked, *(pa.nulls(n, out.field(i).type) for i in (5, 6))],
                                    schema=out)
        summary = pa.Table.from_arrays(
            [pa.array([v]) for v in (number, number % buckets, 0, 0)] + [pa.array([_pack(np.zeros(0))]), pa.array([sums]),
             pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)], schema=out)
        return pa.concat_tables([rows, summary])

    return texts.groupBy("slice").cogroup(targets.groupBy("slice")).applyInArrow(run, schema)


def _totals(keys: np.ndarray, counts: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """For every entry the sums of ``counts`` over the entries of equal keys, and the number of distinct keys."""
    if not len(keys):
        return [c.astype(np.int64) for c in counts], 0
    order = np.argsort(keys)
    s = keys[order]
    new = np.append(True, s[1:] != s[:-1])
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return [np.add.reduceat(c[order].astype(np.int64), at)[group] for c in counts], len(at)


def _split(values: list[np.ndarray], sizes: list[np.ndarray], columns: int) -> list[list[np.ndarray]]:
    """Of bodies with ``columns`` runs for the words and as many for the pairs: the runs, joined over the bodies."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(2 * columns)]
    for x, *n in zip(values, *sizes):
        for i, run in enumerate(np.split(x, np.cumsum(np.repeat(n, columns))[:-1])):
            parts[i].append(run)
    joined = [np.concatenate(p) for p in parts]
    return [joined[:columns], joined[columns:]]


def _answers(asked: DataFrame, id_type: str) -> DataFrame:
    """The rows of ``asked`` with totals over all slices, and without keys, in ``body``; ``distinct``: summed, all
    distinct words."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = [table[k].to_numpy() for k in ("n_words", "n_pairs")]
        bodies = [_unpack(b, 3 * int(n)) for b, n in zip(table["body"].to_pylist(), sizes[0] + sizes[1])]
        distinct, answers = np.zeros(table.num_rows, dtype=np.int64), []
        for i, (n, (gap, *counts)) in enumerate(zip(sizes, _split(bodies, sizes, 3))):
            key = np.cumsum(gap)
            first = np.cumsum(n) - n
            key -= np.repeat(np.append(0, key)[first], n)       # gaps begin anew with every row
            sums, found = _totals(key, counts)
            answers.append((first, n, sums))
            if not i:
                distinct[0] = found
        body = [_pack(np.concatenate([s[first[r]:first[r] + n[r]] for first, n, sums in answers for s in sums]))
                for r in range(table.num_rows)]
        return (table.set_column(table.schema.get_field_index("body"), "body", pa.array(body, pa.binary()))
                .append_column("distinct", pa.array(distinct)))

    return cut_lineage(asked.groupBy("bucket").applyInArrow(
        run, f"slice long, bucket long, n_words long, n_pairs long, body binary, sums array<long>, targets array<{id_type}>, "
             "distinct long"), drop_shuffles=True)


@dataclass(frozen=True)
class Model:
    """What a model knows beside the counts of words and pairs; all counts are multiplied by ``scale`` when used."""

    total: int              # words
    starts: int             # texts that have a word: the history count of a text's start
    size: int               # distinct words of the corpus, and one for all that it does not hold
    scale: float

    def losses(self, word: np.ndarray, joint: np.ndarray, seen: np.ndarray, total: np.ndarray,
               strength: float) -> np.ndarray:
        """Bits of every token from its counts, its own text's left out."""
        unigram = (self.scale * word + 0.5) / (self.scale * total + 0.5 * self.size)
        # Dirichlet smoothing: the unigram model counts as ``strength`` more observations.
        return -np.log2((self.scale * joint + strength * unigram) / (self.scale * seen + strength))


def _own(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For every token, how often its own text holds the same word (or pair)."""
    _, inv, n = np.unique(text * size + at, return_inverse=True, return_counts=True)
    return n[inv]


def _scores(texts: DataFrame, answers: DataFrame, target: Model, background: Model, strength: float, id_col: str,
            id_type: str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([pa.nulls(0, left["id"].type), pa.nulls(0, pa.int64())]
                                        + [pa.nulls(0, pa.float64())] * 3, names=names)
        left, right = left.combine_chunks(), right.sort_by("bucket").combine_chunks()
        x = Slice(pa.concat_arrays(left["text"].chunks))
        n = x.w.counts
        none = n == 0
        losses = [np.zeros(len(n))] * 2
        if len(x.at):
            sizes = [right[k].to_numpy() for k in ("n_words", "n_pairs")]
            bodies = [_unpack(b, 2 * int(k)) for b, k in zip(right["body"].to_pylist(), sizes[0] + sizes[1])]
            words, pairs = _split(bodies, sizes, 2)
            text = x.w.text_of_word()
            first = x.before < 0
            own_word, own_pair = _own(text, x.at, len(x.words)), _own(text, x.pair, len(x.pairs))
            own_seen = np.ones(len(own_word), dtype=np.int64)
            own_seen[1:] = own_word[:-1]
            own_seen[first] = 1
            targets = pa.concat_arrays(right["targets"].chunks).flatten()
            flag = np.repeat(_flags(pa.concat_arrays(left["id"].chunks), targets).astype(np.int64), n)
            losses = []
            for m, word, pair, mine in ((target, words[0], pairs[0], flag),
                                        (background, words[1], pairs[1], np.ones(len(text), dtype=np.int64))):
                bit = m.losses(word[x.at] - mine * own_word, pair[x.pair] - mine * own_pair,
                               np.where(first, m.starts, word[x.before]) - mine * own_seen,
                               m.total - mine * n[text], strength)
                loss = np.zeros(len(n))
                loss[~none] = np.add.reduceat(bit, x.w.first[:-1][~none]) / n[~none]
                losses.append(loss)
        return pa.Table.from_arrays(
            [left["id"], pa.array(n.astype(np.int64)), pa.array(losses[0], mask=none), pa.array(losses[1], mask=none),
             pa.array(losses[0] - losses[1], mask=none)], names=names)

    names = [id_col, "n_words", "target_loss", "background_loss", "loss_difference"]
    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        run, f"`{id_col}` {id_type}, n_words long, target_loss double, background_loss double, loss_difference double")


def loss_differences(docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = None, bits: int | None = None,
                     strength: float = 50.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, target_loss, background_loss, loss_difference`` (bits per token) of every text of ``docs``.

    The texts named by ``target_ids`` (column ``id_col``) are the target. ``vocabulary`` and ``bits`` bounded
    the models once; they are still taken and change nothing, as all words and pairs count.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = corpus.schema["id"].dataType.simpleString()
    n_bytes = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Several buckets a shuffle task, so that tasks are even.
    buckets = max(n_bytes // BUCKET_BYTES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    slices = n_bytes // W.SLICE_BYTES + spark.sparkContext.defaultParallelism

    def dealt(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(slices)).alias("slice")

    # A null id is no target, so its texts may lie anywhere.
    at = F.when(F.col("id").isNull(), dealt("text")).otherwise(dealt("id")).alias("slice")
    texts = corpus.select(at, "id", "text")
    ids = target_ids.select(F.col(id_col).try_cast(id_type).alias("_id")).where("_id IS NOT NULL").distinct()
    answers = _answers(_requests(texts, ids.select(dealt("_id"), "_id"), id_type, buckets), id_type)
    front, back, front_texts, back_texts, distinct = answers.agg(
        *(F.sum(F.get("sums", F.lit(i))) for i in range(4)), F.sum("distinct")).first()
    n_front, n_back, starts_front, starts_back = (int(v or 0) for v in (front, back, front_texts, back_texts))
    size = int(distinct or 0) + 1
    scale = n_front / n_back if n_front and n_back else 1.0
    return _scores(texts, answers.drop("distinct", "sums"), Model(n_front, starts_front, size, 1.0),
                   Model(n_back, starts_back, size, scale), strength, id_col, id_type)
