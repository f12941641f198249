"""Mixing by soft membership: classify texts into domains, then fit document rates to token targets.

``fit_classifier`` learns domains from a labelled table on a bounded sample (``per_domain`` rows a domain,
a multinomial logistic model on selected hashed words and a few layout ratios). ``memberships`` gives every
text a posterior over the domains. ``fit_rates`` finds nonnegative rates r whose expected domain totals
sum_d r_d n_d p_d meet the targets: least squares by projected gradient, each step one distributed sum over
the membership table. With r measured per token (weight n_d) and residuals in the metric of the Gram
matrix G = sum_d n_d p_d p_d' (of the texts whose rate is still positive), the step length is 1, and a step is
r <- max(0, r - p . G^-1 (A r - T)). It runs until the objective stops falling, without a limit on rounds. Starting at 1, it changes the rates as
little as the targets allow.

Edge cases: null and empty texts have no tokens, the prior as posterior and a rate by the same rule;
labels that are null, or of unknown texts, are not used; an id with several domains counts for the first of them
in alphabetical order; more than ``max_domains`` domains are an error; without any label every text is of the domain
``unlabelled`` with rate 1; repeated rows get equal rates; extra columns are not carried by ``rates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm import words as W
from threadlens.llm.sample import first_of_each, label_sample
from threadlens.session import cut_lineage

UNLABELLED = "unlabelled"
BUCKET_BITS = 18
DENSE = 7
SLICE_BYTES = 1 << 20

_UPPER = np.zeros(256)
_UPPER[ord("A"):ord("Z") + 1] = 1
_SYMBOL = np.zeros(256)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_MARK = np.zeros(256)
_MARK[[ord(c) for c in "!?.,;:"]] = 1
_TRAIL = np.zeros(256, dtype=bool)
_TRAIL[[ord(c) for c in "!?.,;:\"')]}"]] = True


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, dense ratios (texts, DENSE), and the distinct (text, word bucket) pairs."""
    w = W.split_words(column)
    n = w.counts
    ends = w.ends.copy()
    for _ in range(3):       # punctuation after a word
        ends -= _TRAIL[w.data[ends - 1]] & (ends - w.starts > 1)
    h = W.SpanHasher(w.data, lower=True)(w.starts, ends)
    text = w.text_of_word()
    # Distinct words per text: one sort of (text, hash) keys.
    key = np.sort((text.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    owner = (key >> np.uint64(44)).astype(np.int64)
    bucket = (W.mix64(key & np.uint64((1 << 44) - 1)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    pair = np.unique(owner << BUCKET_BITS | bucket)
    size, words = np.maximum(np.diff(w.bounds), 1), np.maximum(n, 1)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    dense = np.stack([
        _per_text(_UPPER[w.data], w.bounds) / size, _per_text(_SYMBOL[w.data], w.bounds) / words,
        _per_text(_MARK[w.data], w.bounds) / words, np.log1p(n),
        np.bincount(owner, minlength=len(n)) / words, _per_text(same, w.first) / words,
        _per_text((w.ends - w.starts).astype(float), w.first) / words], axis=1)
    return n, dense, pair >> BUCKET_BITS, pair & ((1 << BUCKET_BITS) - 1)


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    column: np.ndarray     # int32 (2**BUCKET_BITS): feature of a bucket, -1 if not selected
    weights: np.ndarray    # float64 (features, domains)
    dense: np.ndarray      # float64 (3 * DENSE, domains): value, square, and distance from the mean
    bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def posteriors(self, dense: np.ndarray, text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        z = _dense(dense, self.mean, self.scale) @ self.dense + self.bias
        f = self.column[bucket]
        hit = f >= 0
        for j in range(z.shape[1]):
            z[:, j] += np.bincount(text[hit], self.weights[f[hit], j], minlength=len(z))
        return _softmax(z)


def _dense(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z, z * z / 8, np.abs(z)], axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features_of(docs: DataFrame, text_col: str, extra: list[str]) -> DataFrame:
    """``extra`` columns with ``dense`` and the distinct word ``buckets`` of each text."""
    src = docs.select(*extra, F.col(text_col).alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(len(extra))
            for a, b in W.slices(col):
                n, dense, text, bucket = text_features(col.slice(a, b - a))
                cut = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(extra))),
                     pa.array(list(dense), pa.list_(pa.float64())),
                     pa.array([bucket[s:e].astype(np.int32).tobytes() for s, e in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=[*extra, "dense", "buckets"])

    return src.mapInArrow(run, f"{schema}, dense array<double>, buckets binary")


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: Column, per_domain: int = 1000, max_domains: int = 16,
                   min_z: float = 4.0, max_features: int = 4000, rounds: int = 150, id_col: str = "doc_id",
                   text_col: str = "text") -> Classifier:
    """Fit on at most ``3 * per_domain * max_domains`` labelled texts, chosen by a hash of the id."""
    named = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), domain.alias("_domain"))
    named = (named.where("_domain IS NOT NULL").join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
             .groupBy("_id").agg(F.min("_domain").alias("_domain")))
    if named.select("_domain").distinct().limit(max_domains + 1).count() > max_domains:
        raise ValueError(f"more than {max_domains} domains; raise max_domains")
    picked = label_sample(named, "_domain", "_id", per_domain, max_domains)
    texts = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
             .join(F.broadcast(picked), "_id"))
    rows = sorted(_features_of(texts, "_body", ["_id", "_domain"]).collect(), key=lambda r: (str(r["_domain"]), r["_id"]))
    rows = first_of_each(rows, "_domain", 2 * per_domain)
    domains = tuple(sorted({r["_domain"] for r in rows}))
    if not domains:
        return Classifier((UNLABELLED,), np.full(1 << BUCKET_BITS, -1, np.int32), np.zeros((0, 1)),
                          np.zeros((3 * DENSE, 1)), np.zeros(1), np.zeros(DENSE), np.ones(DENSE))
    y = np.array([domains.index(r["_domain"]) for r in rows])
    x = np.array([r["dense"] for r in rows])
    buckets = [np.frombuffer(r["buckets"], dtype=np.int32) for r in rows]
    text = np.repeat(np.arange(len(rows)), [len(b) for b in buckets])
    flat = np.concatenate(buckets).astype(np.int64)
    k, n = len(domains), len(rows)
    per = np.bincount(y, minlength=k)
    df = np.bincount(flat, minlength=1 << BUCKET_BITS)
    best = np.zeros(1 << BUCKET_BITS)
    for j in range(k):       # how far a word's share in a domain is from its share outside
        own = np.bincount(flat[y[text] == j], minlength=1 << BUCKET_BITS)
        a, b = own / max(per[j], 1), (df - own) / max(n - per[j], 1)
        pool = df / n
        sd = np.sqrt(pool * (1 - pool) * (1 / max(per[j], 1) + 1 / max(n - per[j], 1))) + 1e-9
        best = np.maximum(best, np.where(df >= 4, np.abs(a - b) / sd, 0))
    chosen = np.flatnonzero(best >= min_z)
    chosen = np.sort(chosen[np.argsort(-best[chosen], kind="stable")][:max_features])
    column = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    xd = _dense(x, mean, scale)
    f = column[flat]
    ft, ff = text[f >= 0], f[f >= 0]
    prior = per / n
    w, d, bias = np.zeros((len(chosen), k)), np.zeros((xd.shape[1], k)), np.log(prior)
    gold = np.eye(k)[y]
    params, state = [w, d, bias], [[np.zeros_like(p), np.zeros_like(p)] for p in (w, d, bias)]
    for step in range(1, rounds + 1):
        z = xd @ d + bias
        for j in range(k):
            z[:, j] += np.bincount(ft, w[ff, j], minlength=n)
        r = (_softmax(z) - gold) / n
        gw = np.stack([np.bincount(ff, r[ft, j], minlength=len(chosen)) for j in range(k)], axis=1) + 1e-4 * w
        for p, g, (m, v) in zip(params, (gw, xd.T @ r + 1e-5 * d, r.sum(axis=0)), state):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return Classifier(domains, column, w, d, bias, mean, scale)


def memberships(docs: DataFrame, model: Classifier, carry: list[str], text_col: str = "text",
                inside: str | None = None) -> DataFrame:
    """``carry`` columns with ``n_tokens`` (words) and ``posterior`` (array in the order of the domains).

    ``inside``: the text is the field ``text_col`` of this carried column, and goes to the task once.
    """
    src = docs.select(*(F.col(f"`{c}`") for c in carry), *([F.col(text_col).alias("_text")] if inside is None else []))
    schema = T.StructType([*src.schema.fields[:len(carry)], T.StructField("n_tokens", T.LongType()),
                           T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(len(carry)) if inside is None else batch.column(carry.index(inside)).field(text_col)
            for a, b in W.slices(col, SLICE_BYTES):
                n, dense, text, bucket = text_features(col.slice(a, b - a))
                post = model.posteriors(dense, text, bucket)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(carry))), pa.array(n.astype(np.int64)),
                     pa.array(list(post), pa.list_(pa.float64()))], names=[*carry, "n_tokens", "posterior"])

    return src.mapInArrow(run, schema)


def _sums(member: DataFrame, k: int, rate: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain at the given rates, and the Gram matrix of the texts with a positive rate."""
    rate = F.lit(1.0) if rate is None else rate
    row = member.select("n_tokens", "posterior", rate.alias("r"))
    p = [F.col("posterior")[j] for j in range(k)]
    n, live = F.col("n_tokens"), F.when(F.col("r") > 0, F.col("n_tokens")).otherwise(F.lit(0))
    got = row.agg(*[F.sum(n * F.col("r") * x) for x in p],
                  *[F.sum(live * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    flat = np.array([float(v or 0.0) for v in got])
    return flat[:k], flat[k:].reshape(k, k)


def rate_column(steps: list[np.ndarray]) -> Column:
    """The rate after the given gradient steps, from the posterior alone."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])

    def dot(g: Column) -> Column:
        return F.aggregate(F.zip_with("posterior", g, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    return F.aggregate(history, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def fit_rates(member: DataFrame, targets: np.ndarray, tolerance: float = 1e-4) -> list[np.ndarray]:
    """Gradient steps whose replay (``rate_column``) gives the fitted rates.

    A step is measured in the Gram matrix of the texts whose rate is still positive, which meets reachable
    targets in a few rounds. If that step raises the objective, the step in the Gram matrix of all texts,
    which never does, is taken instead.
    """
    k = len(targets)
    totals, gram = _sums(member, k)
    inverse = np.linalg.pinv(gram)
    steps: list[np.ndarray] = []
    first = last = None
    plain = None
    while True:
        rest = totals - targets
        value = float(rest @ inverse @ rest)
        if last is not None and value > last and plain is not None:
            steps[-1], plain = plain, None
        elif last is not None and last - value <= tolerance * first:
            return steps
        else:
            first = value if first is None else first
            if value <= 1e-12 * max(1.0, float(targets @ inverse @ targets)):
                return steps
            last, plain = value, inverse @ rest
            steps.append(np.linalg.pinv(gram) @ rest)
        totals, gram = _sums(member, k, rate_column(steps))


def token_targets(member: DataFrame, domains: tuple[str, ...], weights: dict[str, float],
                  budget: float | None = None) -> np.ndarray:
    """Token totals by domain for the wished weights.

    ``budget``: all tokens wanted; by default such that the domain of the largest weight keeps its tokens.
    Domains without a wished weight get none.
    """
    wish = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    now, _ = _sums(member, len(domains))
    if wish.sum() <= 0:
        return now
    wish = wish / wish.sum()
    top = int(wish.argmax())
    return wish * (now[top] / wish[top] if budget is None else budget)


def fit(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], budget: float | None = None,
        id_col: str = "doc_id", text_col: str = "text",
        **classifier: object) -> tuple[Classifier, list[np.ndarray], DataFrame]:
    """The classifier, the gradient steps of the fitted rates, and the membership table they were fitted on."""
    model = fit_classifier(docs, labels, domain, id_col=id_col, text_col=text_col, **classifier)
    member = cut_lineage(memberships(docs, model, [id_col], text_col))
    known = model.domains != (UNLABELLED,)
    return model, fit_rates(member, token_targets(member, model.domains, weights, budget)) if known else [], member


def rates(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float],
          budget: float | None = None, id_col: str = "doc_id", text_col: str = "text",
          **classifier: object) -> DataFrame:
    """The id, ``n_tokens``, ``domains``, ``posterior`` and ``rate`` of every text."""
    model, steps, member = fit(docs, labels, domain, weights, budget, id_col, text_col, **classifier)
    return member.select(id_col, "n_tokens", F.array(*map(F.lit, model.domains)).alias("domains"),
                         "posterior", rate_column(steps).alias("rate"))


def mixed_rows(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float],
               budget: float | None = None, id_col: str = "doc_id", text_col: str = "text",
               **classifier: object) -> DataFrame:
    """The rows of ``docs``, each as often as the whole part of its rate, and once more where a hash of its id
    and text falls below the fraction, so that the expected domain totals of the rows are those of the rates.

    A rate depends on the text alone, so the second pass over the texts needs no join.
    """
    model, steps, _ = fit(docs, labels, domain, weights, budget, id_col, text_col, **classifier)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       (F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), F.col(text_col)), 11) / F.lit(2.0 ** 53))
                       .alias("_draw"))
    rate = rate_column(steps)
    times = (F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("int")).cast("int")
    return (memberships(rows, model, ["row", "_draw"], text_col, "row").withColumn("times", times).where("times > 0")
            .select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*"))
