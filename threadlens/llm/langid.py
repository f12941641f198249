"""Language ID of every word by a linear-chain conditional random field.

Word emissions are sums of learned weights over hashed features: prefixes and suffixes of one to
four bytes, inner byte trigrams, and the whole word (a learned lexicon, with one extra feature per
language whose training text holds the word).  Transitions between the languages of neighbouring
words are learned too.  Words are labelled by forward-backward over the whole text: blocks of ``BLOCK`` words are
reduced to a transfer matrix each, the forward and backward vectors are carried over the blocks' borders with
these, and each block is then labelled between its two vectors.  So the chain has no cut, texts of any length take
the same steps, and what is held beside a block is two vectors.  A text's language is the one with the largest mean
word posterior, its score that mean.

The model is fitted on a bounded sample of labelled texts (``per_language`` whole texts of each language; more than
``max_languages`` languages are an error), in the driver; a fit is deterministic.  Training sequences mix stretches of different languages, so that the transitions see switches.

Edge cases: a row with a null id is neither held out nor learned from; a null text, or one without a letter, is ``und`` with score 0; a text whose words carry no
known feature gets the model's prior; ties go to the alphabetically first language; without any
labelled row everything is ``und``; repeated rows are judged alike; extra columns are not carried.
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

BLOCK = 128
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
_AFFIX = (1, 2, 3, 4)


@dataclass(frozen=True)
class Model:
    """Weights: ``bits`` hashed features by languages, transitions, and the lexicon of word hashes."""

    languages: tuple[str, ...]
    weights: np.ndarray      # float32 (2**bits + languages, languages): last rows are lexicon features
    transitions: np.ndarray  # float64 (languages, languages)
    lexicon: np.ndarray      # uint64, sorted
    member: np.ndarray       # bool (lexicon, languages)
    bits: int


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is held out; null for a null id, which is not learned from either."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def _features(w: W.Words, idx: np.ndarray, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of the words ``idx``, concatenated, and their bounds per word."""
    s, e = w.starts[idx], w.ends[idx]
    n, mask = e - s, np.uint64((1 << bits) - 1)
    per = 1 + 2 * len(_AFFIX) + np.maximum(n - 2, 0)
    first = np.concatenate(([0], np.cumsum(per)))
    out = np.empty(first[-1], dtype=np.int64)

    def put(slot: int, hashes: np.ndarray, salt: int) -> None:
        out[first[:-1] + slot] = (W.mix64(hashes + np.uint64(salt)) & mask).astype(np.int64)

    span = W.SpanHasher(w.data, lower=True)
    put(0, h[idx], 1)
    for k in _AFFIX:
        put(2 * k - 1, span(s, np.minimum(s + k, e)), 100 + k)
        put(2 * k, span(np.maximum(e - k, s), e), 200 + k)
    tri = np.maximum(n - 2, 0)
    at = np.concatenate(([0], np.cumsum(tri)))
    inner = np.arange(at[-1]) - np.repeat(at[:-1], tri)
    start = np.repeat(s, tri) + inner
    slot = np.repeat(first[:-1] + 1 + 2 * len(_AFFIX), tri) + inner
    out[slot] = (W.mix64(span(start, start + 3) + np.uint64(300)) & mask).astype(np.int64)
    return out, first


def _emissions(model_w: np.ndarray, feats: np.ndarray, first: np.ndarray, known: np.ndarray | None,
               bits: int) -> np.ndarray:
    out = np.add.reduceat(model_w[feats], first[:-1], axis=0) if len(first) > 1 else np.zeros((0, model_w.shape[1]))
    if known is not None:
        out = out + known @ model_w[1 << bits:]
    return out.astype(np.float64)


def _forward_backward(em: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of (sequences, steps, languages), expected transition counts and log likelihood norm."""
    n, steps, k = em.shape
    top = em.max(axis=2, keepdims=True)
    e = np.exp(em - top)
    t = np.exp(trans)
    alpha = np.empty_like(e)
    scale = np.ones((n, steps))
    a = e[:, 0] / k
    for i in range(steps):
        if i:
            a = (a @ t) * e[:, i]
        scale[:, i] = a.sum(axis=1)
        a = a / scale[:, i, None]
        alpha[:, i] = a
    beta = np.ones((n, k))
    post = np.empty_like(e)
    pair = np.zeros((k, k))
    for i in range(steps - 1, -1, -1):
        p = alpha[:, i] * beta
        post[:, i] = p / p.sum(axis=1, keepdims=True)
        if i:
            live = (length > i)[:, None]
            nxt = e[:, i] * beta
            joint = alpha[:, i - 1][:, :, None] * t[None] * nxt[:, None, :]
            if live.any():
                joint = joint / joint.sum(axis=(1, 2), keepdims=True)
                pair += (joint * live[:, :, None]).sum(axis=0)
            b = nxt @ t.T
            beta = np.where(live, b / b.sum(axis=1, keepdims=True), 1.0)
    return post, pair, 0.0


def _transfer(em: np.ndarray, length: np.ndarray, t: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """(blocks, k, k): from the forward vector before a block to the one at its end, up to a factor."""
    n, steps, k = em.shape
    e = np.ascontiguousarray(np.exp(em - em.max(axis=2, keepdims=True)).transpose(1, 0, 2))
    x = np.where(opening[:, None, None], np.eye(k)[None], t[None]) * e[0][:, None, :]
    for i in range(1, steps):
        nxt = (x @ t) * e[i][:, None, :]
        nxt /= nxt.sum(axis=(1, 2), keepdims=True)
        x = np.where((length > i)[:, None, None], nxt, x)
    return x


def _carry(moves: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors before and backward vectors after each block. ``first``, ``count``: blocks of every text."""
    k = moves.shape[1]
    before, after = np.full((len(moves), k), 1.0 / k), np.full((len(moves), k), 1.0 / k)
    for r in range(1, int(count.max(initial=0))):
        b = first[count > r] + r
        v = np.einsum("ni,nij->nj", before[b - 1], moves[b - 1])
        before[b] = v / v.sum(axis=1, keepdims=True)
        b = (first + count - 1)[count > r] - r
        v = np.einsum("nij,nj->ni", moves[b + 1], after[b + 1])
        after[b] = v / v.sum(axis=1, keepdims=True)
    return before, after


def _posteriors(em: np.ndarray, length: np.ndarray, t: np.ndarray, opening: np.ndarray, before: np.ndarray,
                after: np.ndarray) -> np.ndarray:
    """Posteriors of blocks between their forward and backward vectors."""
    n, steps, k = em.shape
    e = np.ascontiguousarray(np.exp(em - em.max(axis=2, keepdims=True)).transpose(1, 0, 2))
    tt = np.ascontiguousarray(t.T)
    alpha = np.empty_like(e)
    a = np.where(opening[:, None], 1.0, before @ t) * e[0]
    for i in range(steps):
        if i:
            a = (a @ t) * e[i]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[i] = a
    beta = after
    for i in range(steps - 1, -1, -1):
        alpha[i] *= beta
        alpha[i] /= alpha[i].sum(axis=1, keepdims=True)
        if i:
            b = (e[i] * beta) @ tt
            b /= b.sum(axis=1, keepdims=True)
            beta = np.where((length > i)[:, None], b, beta)
    return alpha.transpose(1, 0, 2)


def sample(docs: DataFrame, per_language: int, max_languages: int, id_col: str, text_col: str,
           lang_col: str) -> list[tuple[str, str]]:
    """At most ``per_language`` whole labelled texts of each language, chosen by a hash of the id."""
    lab = (docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
           .select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"),
                   F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col)).alias("_h")))
    counts = lab.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(max_languages + 1).collect()
    if not counts:
        return []
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    rows: list[tuple[str, str]] = []
    rate = F.lit(None).cast("double")
    for r in counts:
        rate = F.when(F.col("_lang") == r["_lang"], F.lit(min(1.0, 2.0 * per_language / r["count"]))).otherwise(rate)
    unit = F.pmod(F.col("_h"), F.lit(1 << 30)) / float(1 << 30)
    picked = (lab.where(unit < rate).orderBy("_h", "_id", "_lang").limit(3 * per_language * len(counts))
              .select("_lang", "_text").collect())
    seen: dict[str, int] = {}
    for r in picked:
        if seen.get(r["_lang"], 0) < per_language:
            seen[r["_lang"]] = seen.get(r["_lang"], 0) + 1
            rows.append((r["_lang"], r["_text"]))
    return rows


def fit(docs: DataFrame, per_language: int = 100, max_languages: int = 200, bits: int = 16, rounds: int = 30, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    return fit_rows(sample(docs, per_language, max_languages, id_col, text_col, lang_col),
                    bits, rounds, seed)


def fit_rows(rows: list[tuple[str, str]], bits: int = 16, rounds: int = 60,
             seed: int = 7) -> Model:
    """Maximum likelihood with a small quadratic penalty, by Adam on all sequences at once."""
    langs = tuple(sorted({r[0] for r in rows}))
    k = len(langs)
    if not k:
        return Model((), np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0, np.uint64),
                     np.zeros((0, 0), bool), bits)
    rng = np.random.default_rng(seed)
    w = W.split_words(pa.array([t for _, t in rows], pa.string()))
    h = w.hashes(lower=True)
    label = np.repeat([langs.index(x) for x, _ in rows], w.counts)
    # Lexicon: which languages use a word in the sample.
    uniq, inv = np.unique(h, return_inverse=True)
    use = np.zeros((len(uniq), k))
    np.add.at(use, (inv, label), 1)
    member = use >= 2
    lex, member = uniq[member.any(axis=1)], member[member.any(axis=1)]
    # Sequences: stretches of 4 to 64 words, cut in text order and joined in random order.
    cuts, at = [], 0
    pieces = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        at = a
        while at < b:
            to = min(b, at + int(rng.integers(4, 65)))
            pieces.append(np.arange(at, to))
            at = to
    order = rng.permutation(len(pieces))
    stream = np.concatenate([pieces[i] for i in order])
    cuts = [stream[i:i + BLOCK] for i in range(0, len(stream), BLOCK)]
    grid = np.zeros((len(cuts), BLOCK), dtype=np.int64)
    length = np.array([len(c) for c in cuts])
    for i, c in enumerate(cuts):
        grid[i, :len(c)] = c
    valid = np.arange(BLOCK)[None] < length[:, None]
    words_used, pos = np.unique(grid[valid], return_index=False, return_inverse=True)
    uh, first_at, word_of = np.unique(h[words_used], return_index=True, return_inverse=True)
    feats, first = _features(w, words_used[first_at], h, bits)
    known = _known(uh, lex, member)
    item = np.zeros(grid.shape, dtype=np.int64)
    item[valid] = word_of[pos]
    gold = np.zeros(grid.shape, dtype=np.int64)
    gold[valid] = label[grid[valid]]
    both = valid[:, 1:]
    gold_pair = np.zeros((k, k))
    np.add.at(gold_pair, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    gold_item = np.zeros((len(uh), k))
    np.add.at(gold_item, (item[valid], gold[valid]), 1)
    weights = np.zeros(((1 << bits) + k, k))
    trans = np.zeros((k, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    total, per = valid.sum(), np.diff(first)
    for step in range(1, rounds + 1):
        em = _emissions(weights, feats, first, known, bits)[item]
        em[~valid] = 0.0
        post, pair, _ = _forward_backward(em, length, trans)
        exp_item = np.stack([np.bincount(item[valid], post[..., j][valid], len(uh)) for j in range(k)], axis=1)
        g_item = (exp_item - gold_item) / total
        g = np.empty_like(weights)
        for j in range(k):
            g[:1 << bits, j] = np.bincount(feats, np.repeat(g_item[:, j], per), 1 << bits)
        g[1 << bits:] = known.T @ g_item
        g += 1e-6 * weights
        gt = (pair - gold_pair) / total + 1e-5 * trans
        for p, grad, m, v in ((weights, g, state[0], state[1]), (trans, gt, state[2], state[3])):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            p -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return Model(langs, weights.astype(np.float32), trans, lex, member, bits)


def _known(h: np.ndarray, lexicon: np.ndarray, member: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h), member.shape[1]))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        hit = lexicon[at] == h
        out[hit] = member[at[hit]]
    return out


def label_words(w: W.Words, model: Model) -> np.ndarray:
    """Posterior of every language for every word (words, languages)."""
    k = len(model.languages)
    if len(w.starts) == 0:
        return np.zeros((0, k))
    h = w.hashes(lower=True)
    uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
    feats, first = _features(w, at, h, model.bits)
    em_u = _emissions(model.weights, feats, first, _known(uniq, model.lexicon, model.member), model.bits)
    blocks = -(-w.counts // BLOCK)
    ahead = np.cumsum(blocks) - blocks
    rank = np.arange(blocks.sum()) - np.repeat(ahead, blocks)
    start = np.repeat(w.first[:-1], blocks) + BLOCK * rank
    length, opening = np.minimum(BLOCK, np.repeat(w.first[1:], blocks) - start), rank == 0
    t = np.exp(model.transitions)

    def emitted(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grid = start[part][:, None] + np.arange(int(length[part].max()))[None]
        valid = grid < (start + length)[part][:, None]
        em = em_u[inv[np.where(valid, grid, 0)]]
        em[~valid] = 0.0
        return em, grid, valid

    # Blocks of like length together, so that short texts do not pay for full blocks.
    order = np.argsort(length, kind="stable")
    # Only texts of several blocks hand vectors over.
    several = order[np.repeat(blocks, blocks)[order] > 1]
    moves = np.zeros((len(start), k, k))
    for part in np.array_split(several, -(-len(several) // 2048)) if len(several) else ():
        moves[part] = _transfer(emitted(part)[0], length[part], t, opening[part])
    before, after = _carry(moves, ahead, blocks)
    out = np.empty((len(h), k))
    for part in np.array_split(order, max(1, len(order) // 2048)):
        em, grid, valid = emitted(part)
        out[grid[valid]] = _posteriors(em, length[part], t, opening[part], before[part], after[part])[valid]
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: ``held_out``, ``lang_pred``, ``score``, words and language switches."""
    src = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                      F.col(text_col).alias("_text"))
    return _label(src, model, None)


def predict_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The whole input row as the struct ``row``, with ``lang_pred`` and ``score`` beside it (no join back)."""
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.lit(False).alias("held_out"))
    return _label(src, model, text_col).drop("held_out")


def _label(src: DataFrame, model: Model, inside: str | None) -> DataFrame:
    """``inside``: the text is this field of the first column, and goes to the task once; else it is the third column."""
    first_col = src.columns[0]
    schema = T.StructType([*src.schema.fields[:2], *(T.StructField(n, t) for n, t in (
        ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("n_words", T.LongType()),
        ("n_switches", T.LongType())))])
    body = F.col("_text") if inside is None else F.col(first_col).getField(inside)
    src = src.withColumn("_letter", F.coalesce(body.rlike("\\p{L}"), F.lit(False)))
    langs, k = model.languages, len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2) if inside is None else batch.column(0).field(inside)
            for a, b in W.slices(text, SLICE_BYTES):
                w = W.split_words(text.slice(a, b - a))
                n = w.counts
                letter = np.asarray(batch.column(batch.num_columns - 1).slice(a, b - a).to_pylist(), dtype=bool) & (k > 0)
                best = np.zeros(b - a, dtype=np.int64)
                score = np.zeros(b - a)
                switches = np.zeros(b - a, dtype=np.int64)
                if k and len(w.starts):
                    post = label_words(w, model)
                    some = n > 0
                    mean = np.zeros((b - a, k))
                    mean[some] = np.add.reduceat(post, w.first[:-1][some], axis=0) / n[some, None]
                    best, score = mean.argmax(axis=1), mean.max(axis=1)
                    lab = post.argmax(axis=1)
                    change = np.zeros(len(lab), dtype=np.int64)
                    change[1:] = lab[1:] != lab[:-1]
                    change[w.first[:-1][some]] = 0
                    switches[some] = np.add.reduceat(change, w.first[:-1][some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array([langs[i] if ok else UNKNOWN for i, ok in zip(best, letter)], pa.string()),
                     pa.array(np.where(letter, np.minimum(score, 1.0), 0.0)), pa.array(n.astype(np.int64)),
                     pa.array(np.where(letter, switches, 0))],
                    names=[first_col, "held_out", "lang_pred", "score", "n_words", "n_switches"])

    return src.mapInArrow(run, schema)
