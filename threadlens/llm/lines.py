"""Line near-duplicates by a segment-partition edit join.

Lines are the parts of a text between newlines, without white space around them; empty ones do not count.
Two different lines are linked if their edit distance is at most the allowance of the shorter one: an edit for every
``step`` code points, and at most ``tau``. So two short lines are not alike for being short, and a line under
``step`` code points only matches as it is.

A line of length l and allowance t is cut into t + 1 even segments and indexed by (l, segment number, segment). By the
pigeonhole principle a linked line of length l to l + t holds one of these segments as it stands, at
one of a few places; the places to probe depend on both lengths (multi-match-aware selection). Index and
probe keys meet in one semi-join: a probe goes on if some indexed line of its key differs from it in the parities of its
hashed characters by at most 2 t of 64 bits, which every linked pair meets. So a segment that very many lines share
does not emit its pairs. The lines of the keys that are left meet with their texts, key by key, in blocks of a bounded
number of lines. There pairs are verified with a banded bit-parallel edit distance, each at the first segment they share,
and every line gets its number of links and its earliest neighbour: no pair leaves a block, and a group of near copies is
rows of its lines.

``line_duplicates`` gives one row per text: lines, lines that stand earlier as they are, lines that first
stand here but are linked to an earlier one, and links to other lines. Earlier means a smaller (id, line number).

Edge cases: null and empty texts have no line; rows whose id is null or repeated are counted together, each
row getting the sums; a null id comes before all others, and a line that only such rows hold is linked with
nothing; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm import words as W
from threadlens.session import cut_lineage, discard

_SYMBOL = W.mix64(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
BLOCK_LINES = 4_096         # indexed lines, and probes, that meet in one task
_TRIM = " \t\n\x0b\f\r"


class Lines:
    """Lines of a slice of texts as code points, with hashes of any span."""

    def __init__(self, column: pa.Array):
        texts = [t or "" for t in column.to_pylist()]
        points = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        start = np.cumsum(size + 1) - size - 1
        white = (points == 32) | ((points >= 9) & (points <= 13))
        breaks = np.flatnonzero(points == 10)
        begin = np.concatenate(([0], breaks + 1))
        end = np.append(breaks, len(points))
        seen = np.concatenate(([0], np.cumsum(~white)))
        full = seen[end] > seen[begin]
        # Trim to the first and last visible character.
        visible = np.flatnonzero(~white)
        line = np.flatnonzero(full)
        self.text = np.searchsorted(start, begin[line], side="right") - 1
        first_line = np.searchsorted(begin, start)
        self.number = line - first_line[self.text]
        self.start = visible[seen[begin[line]]] if len(line) else np.zeros(0, dtype=np.int64)
        self.end = visible[seen[end[line]] - 1] + 1 if len(line) else np.zeros(0, dtype=np.int64)
        self.symbol = _SYMBOL[np.minimum(points, 65535)]
        wide = np.flatnonzero(points >= 65535)
        self.symbol[wide] = W.mix64(points[wide].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        up, self.down = W._BYTE_POWERS.get(len(points) + 1)
        self.acc = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.symbol * up[:len(points)], dtype=np.uint64)))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.acc[end] - self.acc[start]) * self.down[start]
        return W.mix64(h + (end - start).astype(np.uint64))

    def parities(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One bit per hashed character class: whether the line holds an odd number of them."""
        bit = np.uint64(1) << (self.symbol >> np.uint64(58))
        total = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bit)))
        return total[end] ^ total[start]


def segments(length: np.ndarray, tau: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``i`` (from 0) of a line of the given length."""
    parts = tau + 1
    base, longer = length // parts, length % parts
    short = parts - longer           # the first segments are the shorter ones
    return i * base + np.maximum(0, i - short), base + (i >= short)


def probe_places(own: np.ndarray, other: np.ndarray, tau: int, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start in a line of length ``own`` where segment ``i`` of one of length ``other`` may stand."""
    at, size = segments(other, tau, i)
    delta = own - other
    low = np.maximum(np.maximum(at - i, at + delta - (tau - i)), 0)
    high = np.minimum(np.minimum(at + i, at + delta + (tau - i)), own - size)
    return low, high, size


def _key(h: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    return W.mix64(h + W.mix64(length.astype(np.uint64) * np.uint64(64) + np.uint64(i + 1)))


def allowance(length: np.ndarray, tau: int, step: int) -> np.ndarray:
    """Edits allowed to a line of the given length."""
    return np.clip(length // step, 0, tau)


def _unique_long(x: Lines, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the distinct lines of at least ``step`` code points."""
    h = x.hash(x.start, x.end)
    _, at = np.unique(h, return_index=True)
    at = at[x.end[at] - x.start[at] >= step]
    return h[at], x.start[at], x.end[at]


def _keys(docs: DataFrame, tau: int, step: int, probe: bool, names: tuple[str, str]) -> DataFrame:
    """``key, line, parities, shape`` of all index (or probe) keys of the lines that may be linked.

    ``shape``: the allowance of the shorter line, which is the indexed one, times 64, and the number of the segment.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(0)):
                x = Lines(batch.column(0).slice(a, b - a))
                h, start, end = _unique_long(x, step)
                own, bits = end - start, x.parities(start, end)

                def rows(keep: np.ndarray, key: np.ndarray, shape: int) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays(
                        [pa.array(W.as_signed(key)), pa.array(W.as_signed(h[keep])), pa.array(W.as_signed(bits[keep])),
                         pa.array(np.full(len(keep), shape, dtype=np.int32))], names=["key", *names, "shape"])

                for t in range(1, tau + 1):
                    for delta in range(t + 1) if probe else (0,):
                        some = np.flatnonzero(allowance(own - delta, tau, step) == t)
                        length, at_start = own[some], start[some]
                        for i in range(t + 1):
                            if not probe:
                                at, size = segments(length, t, i)
                                yield rows(some, _key(x.hash(at_start + at, at_start + at + size), length, i), 64 * t + i)
                                continue
                            low, high, size = probe_places(length, length - delta, t, i)
                            for move in range(2 * t + 1):
                                keep = np.flatnonzero(low + move <= high)
                                if not len(keep):
                                    continue
                                s = at_start[keep] + low[keep] + move
                                yield rows(some[keep], _key(x.hash(s, s + size[keep]), length[keep] - delta, i), 64 * t + i)

    return docs.select("_text").mapInArrow(run, ", ".join(f"{n} long" for n in ("key", *names)) + ", shape int")


def edit_distance_within(x: str, y: str, tau: int) -> bool:
    """Is the edit distance of two strings at most ``tau``?

    Bit-parallel over a band: one machine word holds the vertical differences of the ``2 tau + 1`` rows around
    the main diagonal, and slides one row down with every column. The value on the lowest diagonal of the band
    is followed while the band has rows below it, and along the last row after that.
    """
    if abs(len(x) - len(y)) > tau:
        return False
    lo, top = 0, min(len(x), len(y))
    while lo < top and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < top - lo and x[len(x) - 1 - hi] == y[len(y) - 1 - hi]:
        hi += 1
    x, y = x[lo:len(x) - hi], y[lo:len(y) - hi]
    m, n = len(x), len(y)
    if not m or not n:
        return max(m, n) <= tau
    if m <= tau:        # too short for a band: rows of the plain table
        row = list(range(m + 1))
        for j, d in enumerate(y, 1):
            nxt = [j]
            for i, c in enumerate(x, 1):
                nxt.append(min(row[i] + 1, nxt[-1] + 1, row[i - 1] + (c != d)))
            row = nxt
        return row[m] <= tau
    width = 2 * tau + 1
    ones, last = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | (1 << i)
    # In column j, bit b stands for row j - tau + b. Column 0 grows by one a row from row 1 on.
    vp, vn, value = ones & ~((1 << tau) - 1), 0, tau
    for j in range(1, n + 1):
        match, shift = where.get(y[j - 1], 0), j - tau - 1
        match = (match >> shift if shift >= 0 else match << -shift) & ones
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & ones
        hp, hn = (vn | ~(d0 | vp)) & ones, d0 & vp
        if j + tau <= m:        # along the lowest diagonal of the band
            value += not d0 & last
        else:                   # along the last row
            b = m - j + tau
            value += (hp >> b & 1) - (hn >> b & 1)
        vp, vn = (hn | ~((d0 >> 1) | hp)) & ones, (d0 >> 1) & hp
    return value <= tau


@lru_cache(maxsize=1 << 16)
def _places(length: int, other: int, t: int) -> list[tuple[int, int, int, int]]:
    """For every segment of a line of the given length: its start and end, and the first and last start of it in a line
    of length ``other``."""
    out = []
    for i in range(t + 1):
        at, size = segments(np.array(length), t, i)
        low, high, _ = probe_places(np.array(other), np.array(length), t, i)
        out.append((int(at), int(at + size), int(low), int(high)))
    return out


def _met_before(x: str, y: str, t: int, i: int) -> bool:
    """Does ``y`` hold one of the segments of ``x`` before segment ``i`` where it may stand?"""
    return any(y.startswith(x[at:end], p) for at, end, low, high in _places(len(x), len(y), t)[:i]
               for p in range(low, high + 1))


def _linked(table: pa.Table) -> pa.Table:
    """``line, links, doc_id, number`` (of the earliest neighbour) of the lines of one block that have a link there."""
    table = table.combine_chunks()
    body, line, shape = table["body"].to_pylist(), table["line"].to_numpy(), table["shape"].to_numpy()
    probe, bits = np.asarray(table["probe"].to_pylist(), dtype=bool), table["bits"].to_numpy().view(np.uint64)
    size = np.array([len(x) for x in body], dtype=np.int64)
    # Places of the lines in order, so that the earliest neighbour is the smallest number.
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("number", "ascending")],
                            null_placement="at_start").to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    links, best = np.zeros(len(line), dtype=np.int64), np.full(len(line), len(line), dtype=np.int64)
    probes = np.flatnonzero(probe)
    for a in np.flatnonzero(~probe):
        t, i = int(shape[a]) >> 6, int(shape[a]) & 63
        # Of two lines of one length the one with the smaller hash is the indexed one.
        gap = size[probes] - size[a]
        near = (gap >= 0) & (gap <= t) & ((gap > 0) | (line[a] < line[probes])) & (shape[probes] == shape[a])
        for b in probes[near & (np.bitwise_count(bits[probes] ^ bits[a]) <= 2 * t)]:
            if not _met_before(body[a], body[b], t, i) and edit_distance_within(body[a], body[b], t):
                links[a] += 1
                links[b] += 1
                best[a], best[b] = min(best[a], rank[b]), min(best[b], rank[a])
    keep = np.flatnonzero(links)
    other = pa.array(order[best[keep]])
    return pa.Table.from_arrays([table["line"].take(pa.array(keep)), pa.array(links[keep]), table["doc_id"].take(other),
                                 table["number"].take(other)], names=["line", "links", "doc_id", "number"])


def line_links(docs: DataFrame, places: DataFrame, first: DataFrame, tau: int, step: int) -> DataFrame:
    """``line, links, before``: links of every line that has one, and the first place of its earliest neighbour.

    ``docs``: doc_id, _text; ``places``: their ``line_places``; ``first``: the smallest place of every line.
    """
    written = cut_lineage(_keys(docs, tau, step, False, ("line", "bits")))
    # A line that stands in many partitions is one row a key: the repeats fall where the keys meet.
    index = written.select("key", F.col("line").alias("line_i"), F.col("bits").alias("bits_i"), (F.col("shape") / 64).cast(
        "int").alias("allowed")).repartition("key").dropDuplicates()
    probe = _keys(docs, tau, step, True, ("line", "bits")).repartition("key").dropDuplicates()
    near = ((F.col("line_i") != F.col("line"))
            & (F.bit_count(F.col("bits_i").bitwiseXOR(F.col("bits"))) <= 2 * F.col("allowed")))
    hits = cut_lineage(probe.alias("p").join(index.alias("i"), (F.col("p.key") == F.col("i.key")) & near, "left_semi"),
                       drop_shuffles=True)
    found = cut_lineage(written.join(hits.select("key").distinct(), "key", "left_semi").distinct(), drop_shuffles=True)
    discard(written)
    both = found.withColumn("probe", F.lit(False)).unionByName(hits.withColumn("probe", F.lit(True)))
    wanted = cut_lineage(both.select("line").distinct())
    texts = line_texts(docs, places, wanted).join(first, "line").select("line", "body", "first.*")
    # Blocks of a key: each part of its indexed lines with each part of its probes.
    parts = both.groupBy("key").agg(*(
        F.ceil(F.count(F.when(F.col("probe") == side, 1)) / BLOCK_LINES).cast("int").alias(n) for side, n in ((False, "n_i"), (True, "n_p"))))
    one, many = (lambda n: F.pmod("line", F.col(n)).cast("int")), (lambda n: F.sequence(F.lit(0), F.col(n) - 1))
    dealt = both.join(parts, "key").where("n_i > 0 AND n_p > 0")
    dealt = dealt.select("key", "line", "bits", "shape", "probe", F.explode(F.when(F.col("probe"), F.transform(
        many("n_i"), lambda i: F.struct(i.alias("i"), one("n_p").alias("p")))).otherwise(F.transform(
            many("n_p"), lambda p: F.struct(one("n_i").alias("i"), p.alias("p"))))).alias("block"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    linked = dealt.join(cut_lineage(texts), "line").groupBy("key", "block.i", "block.p").applyInArrow(
        _linked, f"line long, links long, doc_id {id_type}, number long")
    return linked.groupBy("line").agg(F.sum("links").alias("links"), F.min(F.struct("doc_id", "number")).alias("before"))


def line_places(docs: DataFrame) -> DataFrame:
    """``doc_id, number, line`` (hash) of every line that is not empty."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                x = Lines(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + x.text, pa.int64())), pa.array(x.number.astype(np.int64)),
                     pa.array(W.as_signed(x.hash(x.start, x.end)))], names=["doc_id", "number", "line"])

    return docs.select("doc_id", "_text").mapInArrow(run, f"doc_id {id_type}, number long, line long")


def line_texts(docs: DataFrame, places: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, body`` of the wanted lines, read from the text of their first place."""
    first = (places.where("doc_id IS NOT NULL").join(wanted, "line")
             .groupBy("line").agg(F.min(F.struct("doc_id", "number")).alias("p")).select("line", "p.*"))
    lists = first.groupBy("doc_id").agg(F.collect_list(F.struct("line", "number")).alias("list"))
    rows = docs.join(lists.hint("merge"), "doc_id")     # the texts move, at every size
    bodies = (rows.select(F.split("_text", "\n").alias("l"), F.explode("list").alias("e"))
              .select("e.line", F.btrim(F.get("l", F.col("e.number").cast("int")), F.lit(_TRIM)).alias("body"))
              .where("body != ''"))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = Lines(batch.column(1))
            yield batch.filter(pa.array(W.as_signed(x.hash(x.start, x.end)) == batch.column(0).to_numpy()))

    # Of several texts with one id only some hold the line at that place.
    return bodies.mapInArrow(same, "line long, body string").dropDuplicates(["line"])


def line_duplicates(docs: DataFrame, tau: int = 2, step: int = 10, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_exact, n_near, n_links`` of every row.

    ``n_exact``: lines that stand at an earlier place as they are; ``n_near``: lines that first stand here and
    are linked to a line of an earlier place; ``n_links``: links of the text's distinct lines, summed.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    places = cut_lineage(line_places(src))
    first = cut_lineage(places.groupBy("line").agg(F.min(F.struct("doc_id", "number")).alias("first")), drop_shuffles=True)
    linked = cut_lineage(line_links(src, places, first, tau, step), drop_shuffles=True)
    line = cut_lineage(first.join(linked, "line", "left"), drop_shuffles=True)
    at = F.struct("doc_id", "number")
    judged = (places.join(line, "line")
              .select("doc_id", (at > F.col("first")).cast("long").alias("exact"),
                      (at.eqNullSafe(F.col("first")) & F.coalesce(F.col("before") < F.col("first"), F.lit(False)))
                      .cast("long").alias("near"), F.coalesce("links", F.lit(0)).alias("links"), "line"))
    once = judged.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"), F.sum("exact").alias("exact"),
                                                F.sum("near").alias("near"), F.max("links").alias("links"))
    per = once.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.sum("exact").alias("n_exact"),
                                     F.sum("near").alias("n_near"), F.sum("links").alias("n_links"))
    ids = src.select("doc_id")
    per = per.select(F.col("doc_id").alias("_id"), "n_lines", "n_exact", "n_near", "n_links")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_exact", "n_near", "n_links")]
    return ids.join(per, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", *zero)
