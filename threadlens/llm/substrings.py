"""Substring removal: words covered by a window that starts in a text with a smaller id.

A window is ``width`` consecutive words.  Its anchor is the least hashed k-gram inside it
(``k = width // 2 + 1``), so equal windows have equal anchors, and one anchor owns a run of neighbouring
windows: its context.

1. One pass over the texts gives the anchors with a hash of their contexts; anchors of one text only go.
2. Contexts are grouped by content (map-side first). An anchor with a single context needs no more: its
   windows belong to the smallest id that has it.
3. The contexts of the other anchors are the reference. They are cut into shards by anchor, each small
   enough for one task; a shard becomes a suffix automaton whose states carry the smallest id that holds
   their strings, and its contexts are streamed through it: matching statistics of ``width`` or more give
   the smallest id of every window.
4. An anchor with more than ``SHARD_CONTEXTS`` contexts (a passage inside very many texts) would make an
   unbounded shard; its windows take an exact way instead, grouped by their hashes.
5. Every text takes the maximal spans of the windows that belong to a smaller id out of its words.

Automata of all shards are not sent to all tasks, as that work would grow with the square of the corpus;
a shard goes only where texts share its anchors. ``remove_reference`` is the form for a given reference:
there each shard's automaton is broadcast and all texts are streamed past it.

Edge cases: null and empty texts have no word; texts shorter than a window lose nothing; a null id loses
nothing and is no reference; rows that repeat an id are known by id and text (``tkey``, its hash), and lose nothing to
each other; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm import words as W
from threadlens.session import cut_lineage

SHARD_CONTEXTS = 64
SHARD_WORDS = 20_000


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; states carry the least owner of their strings."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]
        self._closed = True

    def _state(self, length: int, step: dict[int, int], link: int, owner: object) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(owner)
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int, owner: object) -> int:
        """A copy of ``q`` for its strings of length up to ``length[p] + 1``."""
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q], owner)
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], owner: object) -> None:
        step, length, link, own = self.step, self.length, self.link, self.owner
        last = 0
        for c in sequence:
            q = step[last].get(c)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._split(last, c, q, owner)
                last = q
            else:
                new = self._state(length[last] + 1, {}, 0, owner)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q, owner)
                last = new
            if own[last] is None or owner < own[last]:
                own[last] = owner
        self._closed = False

    def close(self) -> None:
        """Hand the least owners down the suffix links (longest states first)."""
        own, link = self.owner, self.link
        for v in sorted(range(1, len(own)), key=self.length.__getitem__, reverse=True):
            p = link[v]
            if p > 0 and (own[p] is None or own[v] < own[p]):
                own[p] = own[v]
        self._closed = True

    def owners(self, sequence: list[int], width: int) -> list[object | None]:
        """For every window of ``width`` words: the least owner of an equal window, None if there is none."""
        if not self._closed:
            self.close()
        step, length, link, own = self.step, self.length, self.link, self.owner
        out: list[object | None] = []
        state = have = 0
        for i, c in enumerate(sequence):
            while state and c not in step[state]:
                state = link[state]
                have = length[state]
            nxt = step[state].get(c)
            state, have = (nxt, have + 1) if nxt is not None else (0, 0)
            while state and length[link[state]] >= width:      # the state of the last ``width`` words
                state = link[state]
                have = length[state]
            if i + 1 >= width:
                out.append(own[state] if have >= width else None)
        return out


def anchors(w: W.Words, h: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Text, anchor hash, context hash, first window (word number in the text) and windows of every anchor."""
    k = width // 2 + 1
    span = width - k + 1
    n = w.counts
    per = np.maximum(n - width + 1, 0)
    total = int(per.sum())
    none = np.zeros(0, dtype=np.int64)
    if not total:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    starts = np.arange(len(h) - k + 1)
    g = W.run_hashes(h, starts, starts + k)     # k-grams over text borders are never inside a window
    bits = max(22, int(len(g)).bit_length())
    low = np.uint64((1 << bits) - 1)
    key = (g & ~low) | starts.astype(np.uint64)
    size = 1
    while 2 * size <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[:len(key) - (span - size)], key[span - size:])
    text = np.repeat(np.arange(len(n)), per)
    at = np.arange(total) - np.repeat(np.cumsum(per) - per, per) + np.repeat(w.first[:-1], per)
    where = (key[at] & low).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, total))
    first = at[head]
    context = W.run_hashes(h, first, first + count - 1 + width)
    return text[head], g[where[head]], context, first - w.first[:-1][text[head]], count


def _occurrences(docs: DataFrame, width: int, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                w = W.split_words(batch.column(1).slice(a, b - a))
                text, anchor, context, first, count = anchors(w, w.hashes(), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.as_signed(anchor)), pa.array(W.as_signed(context)),
                     *(batch.column(i).take(pa.array(a + text, pa.int64())) for i in (0, 2)), pa.array(first.astype(np.int32)),
                     pa.array(count.astype(np.int16))], names=["anchor", "context", "doc_id", "tkey", "at", "n"])

    return docs.mapInArrow(run, f"anchor long, context long, doc_id {id_type}, tkey long, at int, n short")


def _context_words(docs: DataFrame, wanted: DataFrame, width: int, id_type: str) -> DataFrame:
    """``anchor, context, doc_id, hot, words`` (word hashes) of the wanted contexts, read from their texts."""
    lists = wanted.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("anchor", "context", "at", "n", "hot")).alias("list"))
    rows = docs.join(lists.hint("merge"), ["doc_id", "tkey"])     # the texts move, at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lists = batch.column(1), batch.column(2)
            for a, b in W.slices(text):
                w = W.split_words(text.slice(a, b - a))
                h = w.hashes()
                for lo in range(a, b, 256):      # contexts of a few texts at a time
                    hi = min(b, lo + 256)
                    cols: list[list] = [[] for _ in range(5)]
                    for i in range(lo, hi):
                        name = batch.column(0)[i].as_py()
                        for e in lists[i].as_py():
                            s = w.first[i - a] + e["at"]
                            item = h[s:s + e["n"] - 1 + width].tobytes()
                            for c, x in zip(cols, (e["anchor"], e["context"], name, e["hot"], item)):
                                c.append(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                         pa.array(cols[2], batch.column(0).type), pa.array(cols[3], pa.bool_()),
                         pa.array(cols[4], pa.binary())], names=["anchor", "context", "doc_id", "hot", "words"])

    return rows.select("doc_id", "_text", "list").mapInArrow(
        run, f"anchor long, context long, doc_id {id_type}, hot boolean, words binary")


def _automaton_owners(contexts: DataFrame, width: int, id_type: str) -> DataFrame:
    """Least owner of every window of the contexts; all contexts of an anchor meet in one shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        arrow_id = pa.int64()

        def shard() -> pa.RecordBatch:
            auto = SuffixAutomaton()
            for _, _, name, seq in held:
                auto.add(seq, name)
            found = [auto.owners(seq, width) for _, _, _, seq in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int64()),
                 pa.array(found, pa.list_(arrow_id))], names=["anchor", "context", "owners"])

        for batch in batches:
            arrow_id = batch.column(2).type
            for row in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3).to_pylist()):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield shard()
                    held, size = [], 0
                seq = np.frombuffer(row[3], dtype=np.uint64).tolist()
                held.append((row[0], row[1], row[2], seq))
                size += len(seq)
        if held:
            yield shard()

    return (contexts.select("anchor", "context", "doc_id", "words").repartition("anchor")
            .sortWithinPartitions("anchor", "context")
            .mapInArrow(run, f"anchor long, context long, owners array<{id_type}>"))


def _hashed_owners(contexts: DataFrame, width: int, id_type: str) -> DataFrame:
    """The same for anchors with very many contexts: least owner by window hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column(3)[i].as_py(), dtype=np.uint64)
                s = np.arange(len(h) - width + 1)
                n = pa.array(np.full(len(s), i, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(n), batch.column(1).take(n), batch.column(2).take(n),
                     pa.array(W.as_signed(W.run_hashes(h, s, s + width))), pa.array(s.astype(np.int32))],
                    names=["anchor", "context", "doc_id", "window", "i"])

    windows = cut_lineage(contexts.select("anchor", "context", "doc_id", "words").mapInArrow(
        run, f"anchor long, context long, doc_id {id_type}, window long, i int"))
    least = cut_lineage(windows.groupBy("window").agg(F.min("doc_id").alias("owner")))
    rows = windows.join(least, "window").select("anchor", "context", "i", "owner")
    return rows.groupBy("anchor", "context").agg(
        F.sort_array(F.collect_list(F.struct("i", "owner"))).alias("l")).select(
        "anchor", "context", F.transform("l", lambda e: e["owner"]).alias("owners"))


def removed_windows(docs: DataFrame, width: int = 50) -> DataFrame:
    """``doc_id, tkey, windows``: first words of all windows that also start in a text with a smaller id."""
    id_type = dict(docs.dtypes)["doc_id"]
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "_text", "tkey")
    every = _occurrences(docs, width, id_type)      # cheaper to compute twice than to write
    shared = cut_lineage(every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                         .where("lo != hi").select("anchor"))
    every = cut_lineage(every.join(shared, "anchor"))
    contexts = cut_lineage(every.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "tkey", "at", "n")).alias("r"))
                           .select("anchor", "context", "r.*"))
    kinds = cut_lineage(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
                        .select("anchor", (F.col("c") > SHARD_CONTEXTS).alias("hot")))
    words = cut_lineage(_context_words(docs, contexts.join(kinds, "anchor"), width, id_type))
    owners = (_automaton_owners(words.where("NOT hot"), width, id_type)
              .unionByName(_hashed_owners(words.where("hot"), width, id_type)))
    known = cut_lineage(contexts.select("anchor", "context", F.col("doc_id").alias("only"))
                        .join(owners, ["anchor", "context"], "left"))
    hit = every.join(known, ["anchor", "context"])
    offsets = F.when(F.col("owners").isNull(),
                     F.when(F.col("only") < F.col("doc_id"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array()))
    offsets = offsets.otherwise(F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("doc_id"), i)),
                                         lambda i: i.isNotNull()))
    return (hit.select("doc_id", "tkey", F.transform(offsets, lambda i: i + F.col("at")).alias("w"))
            .where(F.size("w") > 0).groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("w")).alias("windows")))


def _cover(n: int, windows: np.ndarray, width: int) -> np.ndarray:
    """Words of a text of ``n`` words that lie in one of the windows."""
    delta = np.zeros(n + 1, dtype=np.int64)
    windows = np.unique(windows[windows + width <= n])
    delta[windows] += 1
    np.add.at(delta, windows + width, -1)
    return np.cumsum(delta[:-1]) > 0


def _kept_bytes(w: W.Words, i: int, gone: np.ndarray) -> bytes:
    raw = w.data
    return b" ".join(raw[w.starts[j]:w.ends[j]].tobytes() for j in np.flatnonzero(~gone) + w.first[i])


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the kept words, joined by one space) of every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"),
                      F.xxhash64(F.col(text_col)).alias("tkey"))
    id_type = dict(src.dtypes)["doc_id"]
    rows = src.join(removed_windows(src, width).hint("merge"), ["doc_id", "tkey"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                w = W.split_words(batch.column(1).slice(a, b - a))
                kept, removed = [], []
                for i, n in enumerate(w.counts):
                    found = batch.column(2)[a + i]
                    if found.is_valid:
                        gone = _cover(int(n), found.values.to_numpy().astype(np.int64), width)
                    else:
                        gone = np.zeros(n, dtype=bool)
                    removed.append(int(gone.sum()))
                    kept.append(_kept_bytes(w, i, gone).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(w.counts.astype(np.int64)),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.select("doc_id", "_text", "windows").mapInArrow(
        run, f"doc_id {id_type}, n_words long, n_removed long, kept string")


def remove_reference(docs: DataFrame, reference: DataFrame, width: int = 50, shard_words: int = 200_000,
                     id_col: str = "doc_id", text_col: str = "text", ref_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` after taking out all spans of ``width`` words or more that stand in
    a given reference table. Its texts are cut into shards of at most ``shard_words`` words; the automaton of
    one shard is broadcast and all texts are streamed past it, shard by shard."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = dict(src.dtypes)["doc_id"]
    autos = []
    auto, size = SuffixAutomaton(), 0
    for r in reference.select(ref_col).toLocalIterator():
        w = W.split_words(pa.array([r[0]], pa.string()))
        seq = w.hashes().tolist()
        for at in range(0, max(1, len(seq) - width + 1), shard_words):
            part = seq[at:at + shard_words + width - 1]
            if size and size + len(part) > shard_words:
                auto.close()
                autos.append(docs.sparkSession.sparkContext.broadcast(auto))
                auto, size = SuffixAutomaton(), 0
            auto.add(part, 0)
            size += len(part)
    auto.close()
    autos.append(docs.sparkSession.sparkContext.broadcast(auto))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                w = W.split_words(batch.column(1).slice(a, b - a))
                h = w.hashes()
                kept, removed = [], []
                for i, n in enumerate(w.counts):
                    seq = h[w.first[i]:w.first[i + 1]].tolist()
                    hits = [j for x in autos for j, o in enumerate(x.value.owners(seq, width)) if o is not None]
                    gone = _cover(int(n), np.array(hits, dtype=np.int64), width)
                    removed.append(int(gone.sum()))
                    kept.append(_kept_bytes(w, i, gone).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(w.counts.astype(np.int64)),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return src.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept string")


# The same in plain SQL: all windows by their text.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS t FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS lo FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM f WHERE lo < doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE
              list_transform(list_filter(range(1, len(ws) + 1), lambda j: NOT list_contains(gone, j)), lambda j: ws[j]) END,
              ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
