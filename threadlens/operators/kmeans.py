"""M5: k-means on TF-IDF text as Lloyd rounds over one row of term counts a document.

A term is known by its 64-bit hash ``h``. Texts are dealt out by id once, so a document's terms lie together and
counting needs no second exchange. The rows hold plain counts; the idf goes into the centres instead, and the
documents' norms into their state, so the rows are written once and never joined to the vocabulary again.

* The shared terms (of two documents or more) are numbered by document frequency, and a document's row holds the numbers
  and counts of its terms as two packed arrays. The centres' weight sums over numbered terms are an array of ``k`` columns
  that every round sends to the workers: at most ``SENT_TERMS`` terms have numbers, the most frequent ones. Shared terms
  beyond them (the tail) stay rows ``(id, h, tf, idf)`` and meet a table of sums ``(h, idf, s_0 .. s_k-1)`` by a join.
* A term of a single document touches that document and its own centre only; its squared weights are one number
  (``own``) in the document's state, which gives its exact share of every dot product, norm and drift.
* The start is k-means||: in each of two rounds a document becomes a candidate with a probability of its share of the
  cost, times ``2 k``; only the cost, a sum, comes to the driver. ``k`` of the candidates are chosen by weighted
  k-means++ over the matrix of their dot products (some ``4 k`` rows).
* Every document carries an upper bound of its distance to its centre and a lower bound to all others. Bounds move
  with the centres' drifts, and a document whose bounds still agree keeps its cluster without a look at its row.
* A round is one pass: the rows lie in buckets of the id and meet the documents' state there, and the task that finds a
  document's centre also gives what the document changes in the sums. Sums change only by documents that have moved.

Rounds end when no centre drifts by more than ``tolerance`` or after ``max_iter``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.session import broadcast_if_small, cut_lineage, discard, ensure_checkpoint_dir

BROADCAST_ROWS = 2_000_000
SENT_TERMS = 2_000_000      # shared terms whose weights are sent to the workers, 8 k bytes each
DOCUMENT_ROWS = 4_096       # documents whose terms one task counts
ROUND_ROWS = 16_384         # documents one task of a round looks at
CHUNK = 1 << 18             # entries that are sorted or summed at a time
SLICE = 1 << 16             # cells that are added up together
SLICES = "slice int, cells binary, vals binary"
PRODUCT_CHUNK = 1 << 14     # entries that are multiplied at a time: their rows of the centres stay in the cache


@dataclass
class TermRows:
    """``packed``: ``(id, terms, counts)``, a row a document, in ``buckets`` buckets of the id; ``tail``: ``(id, h, tf, idf)``."""

    packed: DataFrame
    tail: DataFrame | None
    buckets: int
    table: str

    def drop(self) -> None:
        """Delete the rows, which nothing reads any more."""
        self.packed.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")
        discard(self.packed, *([self.tail] if self.tail is not None else []))


@dataclass
class _Sums:
    """Sums of weights by numbered term and cluster: a row of ``s`` for each term in ``places`` (None: for all terms)."""

    places: np.ndarray | None
    s: np.ndarray
    tail: DataFrame | None

    def scaled(self, idf: np.ndarray, sizes: list[float]) -> np.ndarray:
        out = self.s / np.maximum(sizes, 1.0)
        out *= (idf if self.places is None else idf[self.places])[:, None]
        return out


def _pieces(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` entries; row ``i`` has the entries from ``at[i]`` to ``at[i + 1]``."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The int32 entries of a binary column, and where each row's begin."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[at[0]:at[-1]].view(np.int32), (at - at[0]) // 4


def _pack(values: np.ndarray, at: np.ndarray, kind: type = np.int32) -> pa.Array:
    values = np.ascontiguousarray(values, dtype=kind)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [
        None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _starts(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


def term_lists(occurrences: DataFrame, id_col: str) -> DataFrame:
    """``(id, hs, tfs)``: the different terms of a document and their counts, of ``(id, term)`` occurrences dealt out by id."""
    lists = (occurrences.select(F.col(id_col).alias("id"), F.xxhash64("term").alias("h"))
             .groupBy("id").agg(F.collect_list("h").alias("hs")))

    def run(batches):
        for batch in batches:
            h, at = _lists(batch.column(1))
            for i, j in _pieces(at, 4 * CHUNK):
                own, part = np.repeat(np.arange(j - i), np.diff(at[i:j + 1])), h[at[i]:at[j]]
                order = np.lexsort((part, own))
                own, part = own[order], part[order]
                first = np.flatnonzero(np.r_[len(part) > 0, (own[1:] != own[:-1]) | (part[1:] != part[:-1])][:len(part)])
                to = pa.array(_starts(np.bincount(own[first], minlength=j - i)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(to, pa.array(part[first])), pa.ListArray.from_arrays(
                        to, pa.array(np.diff(np.append(first, len(part))).astype(np.int32)))], names=["id", "hs", "tfs"])

    return lists.mapInArrow(run, f"id {dict(lists.dtypes)['id']}, hs array<bigint>, tfs array<int>")


def inverse_frequencies(lists: DataFrame, n_docs: int) -> tuple[DataFrame, float]:
    """``(h, df, idf)`` of the terms of two documents or more, and the idf of all others."""
    df = lists.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    idf = F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1
    return df.select("h", "df", idf.alias("idf")), float(np.log((1.0 + n_docs) / 2) + 1)


def _small(table: DataFrame) -> DataFrame:
    return broadcast_if_small(table, BROADCAST_ROWS)


def _meet(rows: TermRows, table: DataFrame) -> DataFrame:
    """The rows of the documents in ``table``, which alone is exchanged."""
    return rows.packed.join(table.repartition(rows.buckets, "id").hint("shuffle_hash"), "id")


def _cells(terms: np.ndarray, w: np.ndarray, cluster: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``w`` summed by cell, the number of a term times ``k`` and the cluster."""
    cell = terms.astype(np.int64) * k + cluster
    if len(cell) * 16 > width * k:
        total, seen = np.bincount(cell, weights=w, minlength=width * k), np.zeros(width * k, dtype=bool)
        seen[cell] = True
        at = np.flatnonzero(seen)
        return at, total[at]
    at, back = np.unique(cell, return_inverse=True)
    return at, np.bincount(back, weights=w, minlength=len(at))


def _sliced(cell: np.ndarray, value: np.ndarray) -> list[pa.Array]:
    """``slice, cells, vals`` of sorted cells: a row a slice of ``SLICE`` cells."""
    part = cell // SLICE
    first = np.flatnonzero(np.diff(part, prepend=-1))
    at = np.append(first, len(cell))
    return [pa.array(part[first].astype(np.int32)), _pack(cell % SLICE, at), _pack(value, at, np.float64)]


def _totals(slices: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their values, added up where the rows of a slice meet."""
    def run(batches):
        total = {}
        for batch in batches:
            for i, cells, vals in zip(*(c.to_pylist() for c in batch.columns)):
                if i not in total:
                    total[i] = np.zeros(SLICE)
                total[i][np.frombuffer(cells, dtype=np.int32)] += np.frombuffer(vals)
        for i, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype(np.int32).tobytes()]),
                                              pa.array([x[at].tobytes()])], names=["slice", "cells", "vals"])

    tasks = slices.sparkSession.sparkContext.defaultParallelism
    got = slices.select("slice", "cells", "vals").repartition(tasks, "slice").mapInArrow(run, SLICES).collect()
    cell = [np.frombuffer(r["cells"], dtype=np.int32).astype(np.int64) + r["slice"] * SLICE for r in got]
    return np.concatenate([np.empty(0, np.int64), *cell]), np.concatenate([np.empty(0), *(np.frombuffer(r["vals"]) for r in got)])


def _sums(rows: TermRows, idf: np.ndarray, members: DataFrame, k: int, few: bool = False) -> _Sums:
    """Weights of shared terms, summed by the cluster in ``members`` ``(id, norm, a, sign)``; ``few``: only of their terms."""
    width = len(idf)

    def run(batches):
        for batch in batches:
            (terms, at), (counts, _) = _packed(batch.column("terms")), _packed(batch.column("counts"))
            norm, a, sign = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "a", "sign"))
            for i, j in _pieces(at, 8 * CHUNK):
                size, part = np.diff(at[i:j + 1]), slice(at[i], at[j])
                scale = sign[i:j] / np.where(norm[i:j] > 0, norm[i:j], 1.0)
                cell, value = _cells(terms[part], counts[part] * np.repeat(scale, size), np.repeat(a[i:j], size), k, width)
                yield pa.RecordBatch.from_arrays(_sliced(cell, value), names=["slice", "cells", "vals"])

    named = members.select("id", "norm", "a", "sign")
    met = rows.packed.join(F.broadcast(named), "id") if few else _meet(rows, named)
    cell, value = _totals(met.mapInArrow(run, SLICES))
    places = np.unique(cell // k) if few else None
    s = np.zeros((width if places is None else len(places), k))
    s[cell // k if places is None else np.searchsorted(places, cell // k), cell % k] = value * idf[cell // k]
    return _Sums(places, s, None if rows.tail is None else cut_lineage(_tail_sums(rows.tail, members, k)))


def _tail_sums(tail: DataFrame, members: DataFrame, k: int) -> DataFrame:
    w = F.col("sign") * F.col("tf") * F.col("idf") / F.col("norm")
    return (tail.join(_small(members), "id").groupBy("h", "idf")
            .agg(*(F.sum(F.when(F.col("a") == j, w).otherwise(0.0)).alias(f"s_{j}") for j in range(k))))


def _tail_dots(tail: DataFrame, centres: DataFrame, sizes: list[float]) -> DataFrame:
    g = centres.select("h", *((F.col("idf") * F.col(f"s_{j}") / F.lit(max(n, 1.0))).alias(f"g_{j}") for j, n in enumerate(sizes)))
    return tail.join(g, "h").groupBy("id").agg(*(F.sum(F.col("tf") * F.col(f"g_{j}")).alias(f"d_{j}") for j in range(len(sizes))))


def _products(terms: np.ndarray, counts: np.ndarray, at: np.ndarray, places: np.ndarray | None, g: np.ndarray) -> np.ndarray:
    """Dot products of packed documents with the columns of ``g``, whose rows are the terms in ``places`` (None: all)."""
    out = np.zeros((len(at) - 1, g.shape[1]))
    if not len(g):
        return out
    for i, j in _pieces(at, PRODUCT_CHUNK):
        part = slice(at[i], at[j])
        place, w, to = terms[part], counts[part].astype(np.float64), at[i:j + 1] - at[i]
        if places is not None:
            row = np.minimum(np.searchsorted(places, place), len(places) - 1)
            there = places[row] == place
            place, w, to = row[there], w[there], np.append(0, np.cumsum(there))[to]
        x = g.take(place, axis=0, mode="clip")
        for d in np.flatnonzero(np.diff(to)):
            np.dot(w[to[d]:to[d + 1]], x[to[d]:to[d + 1]], out=out[i + d])
    return out


def dots(rows: TermRows, idf: np.ndarray, centres: _Sums, sizes: list[float]) -> DataFrame:
    """``(id, d_0 ..)``: raw dot products of documents and centres over shared terms."""
    names = [f"d_{j}" for j in range(len(sizes))]
    sent = rows.packed.sparkSession.sparkContext.broadcast((centres.places, centres.scaled(idf, sizes)))

    def run(batches):
        for batch in batches:
            (terms, at), (counts, _) = _packed(batch.column("terms")), _packed(batch.column("counts"))
            d = _products(terms, counts, at, *sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(d[:, j]) for j in range(d.shape[1]))], names=["id", *names])

    kind = dict(rows.packed.dtypes)["id"]
    out = rows.packed.mapInArrow(run, ", ".join([f"id {kind}", *(f"{x} double" for x in names)]))
    if rows.tail is not None:
        out = (out.unionByName(_tail_dots(rows.tail, centres.tail, sizes))
               .groupBy("id").agg(*(F.sum(x).alias(x) for x in names)))
    out = cut_lineage(out)
    sent.destroy()
    return out


def _distance(j: int, norm2: float, size: float, centre_of: Column) -> Column:
    """Distance of a document to centre ``j``; ``centre_of`` is the cluster it belonged to when that was made."""
    own = F.when(centre_of == j, F.col("own") / F.lit(max(size, 1.0))).otherwise(F.lit(0.0))
    dot = F.when(F.col("norm") > 0, F.coalesce(f"d_{j}", F.lit(0.0)) / F.col("norm") + own).otherwise(F.lit(0.0))
    length = F.when(F.col("norm") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), length - 2 * dot + F.lit(norm2)))


def assign(state: DataFrame, products: DataFrame, norms: list[float], sizes: list[float], places: int = 9) -> DataFrame:
    """``state`` with ``near`` (the closest centre, the first of equal ones), ``up`` and ``low``: the distances to it
    and to the closest other one."""
    k = len(sizes)
    each = [F.round(_distance(j, norms[j], sizes[j], F.col("a")), places) for j in range(k)]
    rows = state.join(products, "id", "left").select(*state.columns, *(x.alias(f"x_{j}") for j, x in enumerate(each)))
    by = F.array(*(F.struct(F.col(f"x_{j}").alias("x"), F.lit(j).alias("j")) for j in range(k)))
    ranked = rows.withColumn("r", F.array_sort(by))
    low = F.col("r")[1]["x"] if k > 1 else F.lit(float("inf"))
    return ranked.select(*state.columns, F.col("r")[0]["j"].alias("near"), F.col("r")[0]["x"].alias("up"), low.alias("low"))


def lloyd_step(rows: TermRows, idf: np.ndarray, state: DataFrame, centre_ids: list, id_col: str = "id") -> DataFrame:
    """One assignment from fixed centres: the documents ``centre_ids``. ``(id, cluster, distance)`` of every document."""
    k = len(centre_ids)
    own = F.lit(None).cast("int")
    for j, x in enumerate(centre_ids):
        own = F.when(F.col("id") == F.lit(x), F.lit(j)).otherwise(own)
    named = cut_lineage(state.withColumn("a", own))
    seeds = named.where("a IS NOT NULL")
    norms = [0.0] * k
    for r in seeds.select("a", "norm").collect():
        norms[r["a"]] = 1.0 if r["norm"] > 0 else 0.0
    centres = _sums(rows, idf, seeds.select("id", "norm", "a", F.lit(1).alias("sign")), k, few=True)
    out = assign(named, dots(rows, idf, centres, [1.0] * k), norms, [1.0] * k, 6)
    return out.select(F.col("id").alias(id_col), F.col("near").alias("cluster"), F.col("up").alias("distance"))


def centre_table(rows: TermRows, idf: np.ndarray, state: DataFrame, assigned: DataFrame, k: int) -> DataFrame:
    """The centres after an assignment ``(id, cluster)``: ``cluster, n_docs, norm`` (length of the mean weights)."""
    named = cut_lineage(state.join(assigned.select("id", F.col("cluster").alias("a")), "id"))
    c = _Centres(_sums(rows, idf, named.select("id", "norm", "a", F.lit(1).alias("sign")), k), *_members(named), k)
    return state.sparkSession.createDataFrame(
        [(j, int(c.size[j]), float(c.norm2[j]) ** 0.5) for j in range(k)], "cluster int, n_docs long, norm double")


def _uniform(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11) / F.lit(2.0 ** 53)


def _candidates(rows: TermRows, idf: np.ndarray, state: DataFrame, k: int, seed: int) -> list:
    """k-means||: ids of ``k`` documents to start from."""
    first = state.where("norm > 0").orderBy(_uniform(seed), "id").limit(1).collect()
    if not first:
        return [r["id"] for r in state.orderBy("id").limit(k).collect()]
    chosen, new = [], [first[0]["id"]]
    cost = state.select("id", "norm", "own", F.lit(float("inf")).alias("cost"), F.lit(-1).alias("best"))
    for turn in range(3):
        base = len(chosen)
        chosen += new
        tagged = state.join(F.broadcast(state.sparkSession.createDataFrame(
            [(x, j) for j, x in enumerate(new)], f"id {dict(state.dtypes)['id']}, a int")), "id")
        seeds = tagged.select("id", "norm", "a", F.lit(1).alias("sign"))
        centres = _sums(rows, idf, seeds, len(new), few=True)
        named = cost.join(F.broadcast(tagged.select("id", "a")), "id", "left")
        products = dots(rows, idf, centres, [1.0] * len(new))
        seen = assign(named, products, [1.0] * len(new), [1.0] * len(new))
        square = F.col("up") * F.col("up")
        old, cost = cost, cut_lineage(seen.select("id", "norm", "own", F.least("cost", square).alias("cost"), F.when(
            square < F.col("cost"), F.col("near") + base).otherwise(F.col("best")).alias("best")))
        discard(products, old, *([centres.tail] if centres.tail is not None else []))
        total = cost.where("norm > 0").agg(F.sum("cost")).first()[0] or 0.0
        if turn == 2 or total <= 1e-9:
            break
        # About 2 k documents, each by its share of the cost; 8 k bound what comes to the driver.
        draw = _uniform(seed + turn + 1) < 2.0 * k * F.col("cost") / F.lit(total)
        new = [r["id"] for r in cost.where("norm > 0").where(draw).orderBy(_uniform(seed + turn + 1), "id")
               .limit(8 * k).select("id").collect()]
        new = [x for x in new if x not in set(chosen)]
        if not new:
            break
    weight = {r["best"]: r["count"] for r in cost.groupBy("best").count().collect()}
    return _plus_plus(rows, idf, state, chosen, [weight.get(j, 0) for j in range(len(chosen))], k, seed)


def _plus_plus(rows: TermRows, idf: np.ndarray, state: DataFrame, chosen: list, weight: list[int], k: int, seed: int) -> list:
    """Weighted k-means++ among the candidates, by the matrix of their dot products."""
    if len(chosen) <= k:
        return chosen
    table = F.broadcast(state.sparkSession.createDataFrame(
        [(x, j) for j, x in enumerate(chosen)], f"id {dict(state.dtypes)['id']}, j int"))
    tagged = table.join(state.select("id", "norm"), "id")
    s = _sums(rows, idf, tagged.select("id", "norm", F.col("j").alias("a"), F.lit(1).alias("sign")), len(chosen), few=True).s
    gram = s.T @ s
    if rows.tail is not None:
        w = cut_lineage(rows.tail.join(F.broadcast(tagged), "id").select("h", "j", (F.col("tf") * F.col("idf") / F.col("norm")).alias("w")))
        for r in (w.alias("x").join(w.alias("y"), "h").where("x.j < y.j").groupBy("x.j", F.col("y.j").alias("i"))
                  .agg(F.sum(F.col("x.w") * F.col("y.w")).alias("g")).collect()):
            gram[r["j"], r["i"]] += r["g"]
            gram[r["i"], r["j"]] += r["g"]
    np.fill_diagonal(gram, 1.0)
    rng = np.random.default_rng(seed)
    mass = np.array(weight, dtype=float) + 1e-9
    take = [int(rng.choice(len(chosen), p=mass / mass.sum()))]
    near = np.full(len(chosen), np.inf)
    while len(take) < k:
        near = np.minimum(near, np.maximum(0.0, 2.0 - 2.0 * gram[take[-1]]))
        near[take] = 0.0
        p = mass * near
        if p.sum() <= 0:
            p = mass * np.where(np.isin(np.arange(len(chosen)), take), 0.0, 1.0)
        take.append(int(rng.choice(len(chosen), p=p / p.sum())))
    return [chosen[i] for i in take]


def _members(state: DataFrame) -> tuple[dict, dict]:
    """Documents, and the sum of their ``own``, by cluster."""
    got = state.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("own")).collect()
    return {r["a"]: r["n"] for r in got}, {r["a"]: r["own"] for r in got}


class _Centres:
    """Sums, sizes, norms and own-term masses of the clusters."""

    def __init__(self, sums: _Sums, size: dict, own: dict, k: int):
        self.sums, self.k = sums, k
        self.size = [float(size.get(j, 0)) for j in range(k)]
        squares = np.einsum("ij,ij->j", sums.s, sums.s) + _tail_squares(sums.tail, [f"s_{j}" for j in range(k)])
        self.norm2 = [float(squares[j] + own.get(j, 0.0)) / max(n, 1.0) ** 2 for j, n in enumerate(self.size)]


def _tail_squares(table: DataFrame | None, columns: list) -> np.ndarray:
    if table is None:
        return np.zeros(len(columns))
    return np.array([x or 0.0 for x in table.agg(*(F.sum(F.pow(c, F.lit(2.0))) for c in columns)).first()])


def _drifts(old: _Centres, new: _Centres, moves: dict) -> list[float]:
    """How far each centre has gone. ``moves``: documents' ``own``, summed by old and new cluster."""
    k, was, now = old.k, np.maximum(old.size, 1.0), np.maximum(new.size, 1.0)
    out = np.zeros(k)
    for i in range(0, len(new.sums.s), CHUNK):
        gap = new.sums.s[i:i + CHUNK] / now - old.sums.s[i:i + CHUNK] / was
        out += np.einsum("ij,ij->j", gap, gap)
    if new.sums.tail is not None:
        both = old.sums.tail.select("h", *(F.col(f"s_{j}").alias(f"o_{j}") for j in range(k))).join(new.sums.tail, "h", "full")
        out += _tail_squares(both, [F.coalesce(f"s_{j}", F.lit(0.0)) / F.lit(float(now[j]))
                                    - F.coalesce(f"o_{j}", F.lit(0.0)) / F.lit(float(was[j])) for j in range(k)])
    for (a, near), own in moves.items():
        for j in range(k):
            out[j] += own * ((near == j) / now[j] - (a == j) / was[j]) ** 2
    return [float(np.sqrt(x)) for x in out]


def _look(rows: TermRows, idf: np.ndarray, centres: _Centres, open_docs: DataFrame):
    """One look at the documents in ``open_docs`` ``(id, norm, own, a)``: with ``near``, ``up`` and ``low`` as ``assign``
    gives them, and rows ``(slice, cells, vals)`` of what those that move change in the sums. Also what was sent for it."""
    k, width, norm2, size = centres.k, len(idf), np.array(centres.norm2), np.maximum(centres.size, 1.0)
    tail = [f"d_{j}" for j in range(k)] if rows.tail is not None else []
    sent = rows.packed.sparkSession.sparkContext.broadcast(centres.sums.scaled(idf, centres.size))

    def run(batches):
        for batch in batches:
            (terms, at), (counts, _) = _packed(batch.column("terms")), _packed(batch.column("counts"))
            norm, own, a = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "own", "a"))
            d = _products(terms, counts, at, None, sent.value)
            for j, c in enumerate(tail):
                d[:, j] += batch.column(c).to_numpy(zero_copy_only=False)
            there, each = norm > 0, np.arange(len(a))
            scale = np.where(there, norm, 1.0)
            dot = d / scale[:, None]
            dot[each, a] += own / size[a]
            dot[~there] = 0.0
            x = np.round(np.sqrt(np.maximum(0.0, there[:, None] - 2 * dot + norm2)), 9)
            near = x.argmin(axis=1).astype(np.int32)
            up = x[each, near]
            x[each, near] = np.inf
            doc = [*(batch.column(c) for c in ("id", "norm", "own", "a")), pa.array(near), pa.array(up), pa.array(x.min(axis=1))]
            yield pa.RecordBatch.from_arrays([*doc, *(pa.nulls(len(a), t) for t in (pa.int32(), pa.binary(), pa.binary()))], names=names)
            moved, n = near != a, np.diff(at)
            for i, j in _pieces(at, 8 * CHUNK):
                go = np.flatnonzero(np.repeat(moved[i:j], n[i:j])) + at[i]
                if not len(go):
                    continue
                of = np.repeat(each[i:j], n[i:j])[go - at[i]]
                w = counts[go] / scale[of]
                cell, value = _cells(np.r_[terms[go], terms[go]], np.r_[w, -w], np.r_[near[of], a[of]], k, width)
                change = _sliced(cell, value)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(change[0]), c.type) for c in doc), *change], names=names)

    docs = open_docs.select("id", "norm", "own", "a")
    if rows.tail is not None:
        part = _tail_dots(rows.tail.join(_small(docs.select("id")), "id", "left_semi"), centres.sums.tail, centres.size)
        docs = docs.join(part, "id", "left").select("id", "norm", "own", "a", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in tail))
    schema = (f"id {dict(docs.dtypes)['id']}, norm double, own double, a int, near int, up double, low double, "
              + SLICES)
    names = [x.split()[0] for x in schema.split(", ")]
    return _meet(rows, docs).mapInArrow(run, schema), sent


def fit(rows: TermRows, idf: np.ndarray, state: DataFrame, k: int = 8, max_iter: int = 100, tolerance: float = 1e-4,
        seed: int = 1) -> tuple[DataFrame, list[dict]]:
    """``(id, cluster, distance bound)`` of every document, and what each round did (documents looked at, moved)."""
    seeds = _candidates(rows, idf, state, k, seed)
    if not seeds:
        return state.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")), []
    k = len(seeds)
    start = cut_lineage(lloyd_step(rows, idf, state, seeds))
    written = cut_lineage(state.join(start.select("id", F.col("cluster").alias("a")), "id"))
    now = written.withColumn("up", F.lit(float("inf"))).withColumn("low", F.lit(0.0))
    sums = _sums(rows, idf, now.select("id", "norm", "a", F.lit(1).alias("sign")), k)
    discard(start)
    centres, history = _Centres(sums, *_members(now), k), []
    while len(history) < max_iter:
        judged, sent = _look(rows, idf, centres, now.where("up > low"))
        rest = now.where("NOT (up > low)").select("id", "norm", "own", "a", F.col("a").alias("near"), "up", "low")
        after = cut_lineage(judged.withColumn("seen", F.lit(1)).unionByName(rest.withColumn("seen", F.lit(0)), allowMissingColumns=True))
        sent.destroy()
        discard(written)
        written, docs = after, after.where("slice IS NULL")
        pairs = docs.groupBy("a", "near").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("own"), F.sum("seen").alias("seen")).collect()
        looked, n_moved = sum(r["seen"] for r in pairs), sum(r["n"] for r in pairs if r["a"] != r["near"])
        now = docs.select("id", "norm", "own", F.col("near").alias("a"), "up", "low")
        if not looked:
            break
        history.append({"looked": looked, "moved": n_moved})
        if not n_moved:
            break
        cell, value = _totals(after.where("slice IS NOT NULL"))
        s = centres.sums.s.copy()
        s[cell // k, cell % k] += value * idf[cell // k]
        tail = None
        if rows.tail is not None:
            change = docs.where("near != a").select("id", "norm", F.explode(F.array(
                F.struct(F.col("near").alias("a"), F.lit(1).alias("sign")), F.struct(F.col("a"), F.lit(-1).alias("sign")))).alias("e"))
            delta = _tail_sums(rows.tail, change.select("id", "norm", "e.*"), k)
            tail = cut_lineage(centres.sums.tail.unionByName(delta).groupBy("h", "idf").agg(
                *(F.sum(f"s_{j}").alias(f"s_{j}") for j in range(k))))
        size, mass, moves = {}, {}, {}
        for a, near, n, own, _ in pairs:
            size[near], mass[near], moves[a, near] = size.get(near, 0) + n, mass.get(near, 0.0) + own, own
        fresh = _Centres(_Sums(None, s, tail), size, mass, k)
        drift = _drifts(centres, fresh, moves)
        by = F.create_map(*(F.lit(x) for j in range(k) for x in (j, drift[j])))
        # The farthest any other centre can have come closer.
        far = F.create_map(*(F.lit(x) for j in range(k) for x in (j, max([0.0, *(d for i, d in enumerate(drift) if i != j)]))))
        now = now.select("id", "norm", "own", "a", (F.col("up") + by[F.col("a")]).alias("up"),
                         (F.col("low") - far[F.col("a")]).alias("low"))
        if tail is not None:
            discard(centres.sums.tail)
        centres = fresh
        if max(drift) <= tolerance:
            break
    return now.select("id", F.col("a").alias("cluster"), F.col("up").alias("distance")), history


def _numbered(idf: DataFrame, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shared terms: their hashes in order, their numbers, and the idf by number."""
    table = (idf if n_terms <= SENT_TERMS else idf.orderBy(F.desc("df"), "h").limit(SENT_TERMS)).toArrow()
    h, df, weight = (table[c].to_numpy() for c in ("h", "df", "idf"))
    by_df, by_h = np.lexsort((h, -df)), np.argsort(h)
    number = np.empty(len(h), dtype=np.int32)
    number[by_df] = np.arange(len(h), dtype=np.int32)
    return h[by_h], number[by_h], weight[by_df]


def _number(h: np.ndarray, known: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The numbers of terms, -1 for those without."""
    if not len(known):
        return np.full(len(h), -1, dtype=np.int32)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, number[at], np.int32(-1))


def prepare(docs: DataFrame, occurrences: DataFrame, id_col: str) -> tuple[TermRows, np.ndarray, DataFrame]:
    """The written rows of counts, the idf of numbered terms, and the documents' state ``(id, norm, own)``: the length
    of the raw weights, and the squared normalised weights of its own terms."""
    spark = docs.sparkSession
    lists = cut_lineage(term_lists(occurrences, id_col))
    ids = cut_lineage(docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct())
    kind, n_docs = dict(ids.dtypes)["id"], ids.count()
    table, rare = inverse_frequencies(lists, n_docs)
    shared = cut_lineage(table)
    n_terms = shared.count()
    known, number, idf = _numbered(shared, n_terms)
    sent = spark.sparkContext.broadcast((known, number, idf))

    def pack(batches):
        known, number, idf = sent.value
        for batch in batches:
            (h, at), (tf, _) = _lists(batch.column("hs")), _lists(batch.column("tfs"))
            place, of = _number(h, known, number), np.repeat(np.arange(len(at) - 1), np.diff(at))
            there, n = place >= 0, len(at) - 1
            w = tf[there] * idf[place[there]]
            to = _starts(np.bincount(of[there], minlength=n))
            alone = np.bincount(of[~there], weights=tf[~there].astype(np.float64) ** 2, minlength=n)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(np.bincount(of[there], weights=w * w, minlength=n)), pa.array(alone),
                _pack(place[there], to), _pack(tf[there], to)], names=["id", "ww", "tt", "terms", "counts"])

    def rest(batches):
        known, number, _ = sent.value
        for batch in batches:
            (h, at), (tf, _) = _lists(batch.column("hs")), _lists(batch.column("tfs"))
            out = np.flatnonzero(_number(h, known, number) < 0)
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))[out]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), pa.array(h[out]), pa.array(tf[out])],
                                             names=["id", "h", "tf"])

    named = lists.where("id IS NOT NULL")
    empty = ids.join(named.select("id"), "id", "left_anti").select(
        "id", F.lit(0.0).alias("ww"), F.lit(0.0).alias("tt"), F.lit(b"").alias("terms"), F.lit(b"").alias("counts"))
    packed = named.mapInArrow(pack, f"id {kind}, ww double, tt double, terms binary, counts binary").unionByName(empty)
    buckets = max(min(spark.sparkContext.defaultParallelism, -(-n_docs // 1024)), -(-n_docs // ROUND_ROWS), 1)
    name = f"threadlens_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    packed.repartition(buckets, "id").write.bucketBy(buckets, "id").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    per, tail = out.select("id", "ww", "tt"), None
    if n_terms > SENT_TERMS:
        tail = cut_lineage(named.mapInArrow(rest, f"id {kind}, h long, tf int").join(shared.select("h", "idf"), "h"))
        met = tail.groupBy("id").agg(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2.0))).alias("xx"), F.sum(
            F.pow(F.col("tf").cast("double"), F.lit(2.0))).alias("nn"))
        per = per.join(met, "id", "left").select("id", (F.col("ww") + F.coalesce("xx", F.lit(0.0))).alias("ww"),
                                                 (F.col("tt") - F.coalesce("nn", F.lit(0.0))).alias("tt"))
    own = F.col("tt") * F.lit(rare) * F.lit(rare)
    state = cut_lineage(per.withColumn("aa", own).withColumn("ww", F.col("ww") + F.col("aa")).select(
        "id", F.sqrt("ww").alias("norm"), F.when(F.col("ww") > 0, F.col("aa") / F.col("ww")).otherwise(0.0).alias("own")))
    sent.destroy()
    discard(lists, shared, ids)
    packed = out.select("id", "terms", "counts")
    packed._written_path = path
    return TermRows(packed, tail, buckets, name), idf, state


def kmeans_terms(docs: DataFrame, occurrences: DataFrame, id_col: str, k: int = 8, max_iter: int = 100,
                 tolerance: float = 1e-4, seed: int = 1) -> DataFrame:
    """M5: ``(id, cluster)`` of every row of ``docs`` from its ``(id, term)`` occurrences (M1 weights)."""
    rows, idf, state = prepare(docs, occurrences, id_col)
    found, _ = fit(rows, idf, state, k, max_iter, tolerance, seed)
    rows.drop()
    return found.select(F.col("id").alias(id_col), "cluster")
