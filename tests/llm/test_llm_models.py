"""Mixing, LM scoring, packing and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlens.llm import lmscore, mixing, packing
from threadlens.llm import words as W


def two_kinds(vocab, n, seed):
    """Texts of two kinds: plain words, and plain words with a few marked ones."""
    rng = random.Random(seed)
    plain, marked = vocab[:2000], vocab[2000:2020]
    texts, kinds = [], []
    for _ in range(n):
        kind = rng.random() < 0.3
        w = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if kind:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(marked))
        texts.append(" ".join(w))
        kinds.append("bad" if kind else "good")
    return texts, kinds


def test_rates_meet_targets(make_docs, edge_texts, spark, vocab):
    texts, kinds = two_kinds(vocab, 500, 1)
    docs = make_docs(texts + edge_texts)
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kinds) if i % 2] + [(None, "bad"), (10 ** 6, "good")],
                                   "doc_id long, kind string")
    weights = {"good": 0.9, "bad": 0.1}
    model = mixing.fit_classifier(docs, labels, F.col("kind"))
    got = mixing.rates(docs, labels, F.col("kind"), weights).toPandas().set_index("doc_id").sort_index()
    assert len(got) == len(texts) + len(edge_texts) and (got.rate >= 0).all()
    post = np.array(got.posterior.tolist())
    assert np.allclose(post.sum(axis=1), 1)
    held = [i for i in range(len(texts)) if i % 2 == 0]
    assert np.mean([model.domains[post[i].argmax()] == kinds[i] for i in held]) > 0.95
    # The oracle: the same least squares, solved in one piece.
    n = got.n_tokens.to_numpy(float)
    now = n @ post
    good = model.domains.index("good")
    want = np.array([0.9 if d == "good" else 0.1 for d in model.domains]) * now[good] / 0.9
    assert np.allclose((n * got.rate.to_numpy()) @ post, want, rtol=1e-3)
    assert got.rate[[i for i in held if kinds[i] == "good"]].mean() > 0.9
    kept = mixing.mixed_rows(docs, labels, F.col("kind"), {"good": 0.99, "bad": 0.01})
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert np.mean([(i in ids) == (kinds[i] == "good") for i in held]) > 0.95


@pytest.mark.parametrize("bad", [0.02, 0.12, 0.4])
def test_mixed_rows_meet_targets(make_docs, spark, vocab, bad):
    """Domain totals of the rows written, at rates of the unwished domain near 0.05, 0.3 and 1.5."""
    texts, kinds = two_kinds(vocab, 1500, 2)
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kinds) if i % 2], "doc_id long, kind string")
    weights = {"good": 1 - bad, "bad": bad}
    model, _, member = mixing.fit(docs, labels, F.col("kind"), weights)
    want = mixing.token_targets(member, model.domains, weights)
    kept = mixing.mixed_rows(docs, labels, F.col("kind"), weights)
    assert kept.columns == docs.columns
    got, _ = mixing._sums(mixing.memberships(kept, model, ["doc_id"]), len(want))
    by = dict(zip(model.domains, got / want))
    assert by["good"] == pytest.approx(1, rel=0.05) and by["bad"] == pytest.approx(1, rel=0.4 if bad < 0.1 else 0.2 if bad < 0.2 else 0.1)


def test_rates_without_labels(make_docs, edge_texts, spark):
    none = spark.createDataFrame([], "doc_id long, kind string")
    docs = make_docs(edge_texts)
    rows = mixing.rates(docs, none, F.col("kind"), {"good": 1.0}).collect()
    assert {r["rate"] for r in rows} == {1.0} and len(rows) == len(edge_texts)
    assert mixing.mixed_rows(docs, none, F.col("kind"), {}).count() == len(edge_texts)
    assert mixing.rates(make_docs([]), none, F.col("kind"), {"good": 1.0}).count() == 0


def test_two_labels_of_one_id_and_too_many_domains(make_docs, spark, vocab):
    texts, kinds = two_kinds(vocab, 60, 4)
    pairs = [(i, k) for i, k in enumerate(kinds)] * 2 + [(i, "zz") for i in range(0, 60, 2)] + [(1, None)]
    docs = make_docs(texts)
    labels = spark.createDataFrame(pairs, "doc_id long, kind string")
    assert mixing.fit_classifier(docs, labels, F.col("kind"), rounds=3).domains == ("bad", "good")
    many = spark.createDataFrame([(i, f"k{i}") for i in range(17)], "doc_id long, kind string")
    with pytest.raises(ValueError, match="max_domains"):
        mixing.fit_classifier(docs, many, F.col("kind"))
    assert len(mixing.fit_classifier(docs, many, F.col("kind"), max_domains=17, rounds=3).domains) == 17


def test_projection_keeps_rates_nonnegative(spark):
    rows = [(i, 100, [1.0, 0.0]) for i in range(5)] + [(9, 100, [0.2, 0.8])]
    member = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    steps = mixing.fit_rates(member, np.array([500.0, 0.0]))
    got = {r["doc_id"]: r["r"] for r in member.select("doc_id", mixing.rate_column(steps).alias("r")).collect()}
    assert got[9] == pytest.approx(0, abs=1e-3) and got[0] == pytest.approx(1, abs=1e-2)


def test_loss_differences(make_docs, edge_texts, spark, vocab):
    rng = random.Random(7)
    halves = vocab[:60], vocab[60:2000]
    texts = [" ".join(rng.choice(halves[i % 2]) for _ in range(40)) for i in range(200)]
    docs = make_docs(texts + edge_texts)
    target = spark.createDataFrame([(i,) for i in range(0, 100, 2)] + [(None,)], "doc_id long")
    rows = {r["doc_id"]: r for r in lmscore.loss_differences(docs, target, vocabulary=4096, bits=14).collect()}
    assert len(rows) == len(texts) + len(edge_texts)
    near = [rows[i]["loss_difference"] for i in range(100, 200, 2)]      # like the target, but not in it
    far = [rows[i]["loss_difference"] for i in range(101, 200, 2)]
    assert max(near) < min(far)
    for i, t in enumerate(edge_texts):
        r = rows[len(texts) + i]
        assert (r["loss_difference"] is None) == (not (t or "").split()) == (r["n_words"] == 0)
    assert lmscore.loss_differences(make_docs([]), target).count() == 0
    assert lmscore.loss_differences(docs, target.limit(0), vocabulary=64, bits=8).count() == len(rows)


def test_loss_against_plain_counts(make_docs, spark):
    """Two texts, no hash collisions: the formula by hand, each text left out of its own counts."""
    import math

    docs = make_docs(["a b a b", "a b c"])
    rows = {r["doc_id"]: r for r in lmscore.loss_differences(
        docs, spark.createDataFrame([(0,)], "doc_id long"), vocabulary=8, bits=16, strength=2.0).collect()}
    # Text 1 against the target (text 0): words a 2, b 2, c 0, others 0; start 1; ab 2, ba 1.
    uni = {"a": 2.5 / 6, "b": 2.5 / 6, "c": 0.5 / 6}
    want = -(math.log2((1 + 2 * uni["a"]) / 3) + math.log2((2 + 2 * uni["b"]) / 4) + math.log2((0 + 2 * uni["c"]) / 4)) / 3
    assert rows[1]["target_loss"] == pytest.approx(want)


def test_losses_count_every_word_and_pair(make_docs, spark):
    """More distinct words than 2**16, and pairs that would share some of 2**20 cells: plain counts."""
    import math
    from collections import Counter

    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(40) if rng.random() < 0.3 else rng.randrange(200_000)}" for _ in range(500))
             for _ in range(400)] + ["w1 w2 W1 w2", "w1 w2 w1 w2", None, ""]
    target = set(range(0, 400, 4)) | {400}
    got = {r["doc_id"]: r for r in lmscore.loss_differences(
        make_docs(texts), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}
    tokens = [(t or "").lower().split() for t in texts]
    assert len({x for t in tokens for x in t}) > 1 << 16

    def counts(some):
        return (Counter(x for t in some for x in t), Counter(p for t in some for p in zip([None, *t], t)),
                sum(map(len, some)), sum(map(bool, some)))

    sides = [counts([tokens[i] for i in sorted(target)]), counts(tokens)]
    size = len(sides[1][0]) + 1
    for i in (0, 1, 2, 4, 7, 399, 400, 401):
        t = tokens[i]
        own = counts([t])
        for name, (word, pair, total, starts), scale, mine in (
                ("target_loss", sides[0], 1.0, i in target), ("background_loss", sides[1], sides[0][2] / sides[1][2], 1)):
            bits = 0.0
            for p, x in zip([None, *t], t):
                uni = (scale * (word[x] - mine * own[0][x]) + 0.5) / (scale * (total - mine * own[2]) + 0.5 * size)
                seen = starts - mine if p is None else word[p] - mine * own[0][p]
                bits -= math.log2((scale * (pair[p, x] - mine * own[1][p, x]) + 50 * uni) / (scale * seen + 50))
            assert got[i][name] == pytest.approx(bits / len(t), rel=1e-9), (i, name)
    assert got[402]["target_loss"] is None and got[403]["n_words"] == 0


def test_losses_write_totals_only(make_docs, spark, monkeypatch):
    """No text and no key is written, one 64-bit key stands for a pair, and the shuffle of a write is gone after it."""
    from threadlens import session

    written = []

    def cut(df, drop_shuffles=False):
        written.append((df.dtypes, drop_shuffles))
        return session.cut_lineage(df, drop_shuffles)

    monkeypatch.setattr(lmscore, "cut_lineage", cut)
    docs = make_docs(["a b a b", "a b c", None, "c a"], ids=[0, 0, None, 2])
    rows = lmscore.loss_differences(docs, spark.createDataFrame([(0,), (0,), (None,)], "doc_id long")).collect()
    assert sorted((r["doc_id"] is None, r["n_words"]) for r in rows) == [(False, 2), (False, 3), (False, 4), (True, 0)]
    assert [drop for _, drop in written] == [True]
    names = {n for dtypes, _ in written for n, _ in dtypes}
    assert not names & {"text", "words", "pairs", "prev", "next"}
    assert spark.conf.get(session.DROP_SHUFFLES) == "false"


@pytest.fixture(scope="module")
def enc():
    return packing.encoding(packing.read_ranks())


def test_tokenize_is_the_whole_text_encoding(enc, edge_texts):
    texts = [t for t in edge_texts] + [" a  b\n c ", "x  y  z", "it's  we'll don't", "a b", " ", "  ", "à la ñ ü",
                                       "tab\t x\n\n y ", "1 2 3", "日本 語 です", "é b", "　 a 　b"]
    ids, cut = packing.tokenize(pa.array(texts, pa.string()), enc)
    for i, t in enumerate(texts):
        assert ids[cut[i]:cut[i + 1]].tolist() == enc.encode_ordinary(t or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab '.\n\t  é1語 ", max_size=20), min_size=1, max_size=4))
def test_tokenize_any_text(texts):
    e = packing.encoding(packing.read_ranks())
    ids, cut = packing.tokenize(pa.array(texts, pa.string()), e)
    for i, t in enumerate(texts):
        assert ids[cut[i]:cut[i + 1]].tolist() == e.encode_ordinary(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing(lengths):
    rows = packing.best_fit_decreasing(lengths, 20)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    # The plain form: scan all rows for the fullest one that fits.
    free = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [x for x in free if x >= lengths[i]]
        if fit:
            free.remove(min(fit))
        free.append((min(fit) if fit else 20) - lengths[i])
    assert sorted(20 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


@pytest.mark.parametrize("buffer_tokens", [2_000_000, 500])
def test_packing_round_trip(make_docs, edge_texts, enc, vocab, buffer_tokens):
    texts = edge_texts + [" ".join(vocab[i:i + 7]) for i in range(0, 600, 7)]
    rows = packing.pack(make_docs(texts), capacity=256, buffer_tokens=buffer_tokens).collect()
    end, pieces = len(packing.read_ranks()), {}
    for r in rows:
        ids = packing.matrix_row(r["input_ids"], r["id_bytes"])
        cum = r["cu_seqlens"]
        assert len(ids) == 256 and cum[0] == 0 and cum[-1] == r["n_tokens"] <= 256 and cum == sorted(cum)
        assert (ids[r["n_tokens"]:] == end).all() and r["position_resets"] == cum[:-1]
        for d, at, a, b in zip(r["doc_ids"], r["text_offsets"], cum[:-1], cum[1:]):
            pieces.setdefault(d, []).append((at, ids[a:b].tolist()))
    for i, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        got = sorted(pieces.get(i, []))
        assert all(a + len(x) == b for (a, x), (b, _) in zip(got, got[1:]))
        flat = [x for _, p in got for x in p]
        assert flat == (want + [end] if want else [])
        assert enc.decode(flat[:-1]) == (t or "")
    assert packing.pack(make_docs([])).count() == 0


def test_pipeline(make_docs, spark, edge_texts, vocab, tmp_path):
    import corpus_pipeline as cp

    texts, kinds = two_kinds(vocab, 300, 3)
    bench = " ".join(vocab[100:140])
    texts += [texts[0], texts[0] + " extra", "12 34 --", None, "", texts[1] + " " + bench] + edge_texts
    langs = ["en"] * len(texts)
    base = str(tmp_path)
    docs = make_docs(texts, langs=langs).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(k == "bad")) for i, k in enumerate(kinds) if i % 2],
                          "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    assert [n for n, _ in cp.STAGES] and len(cp.STAGES) == 5
    got, left = docs, []
    for i, (_, stage) in enumerate(cp.STAGES):
        got = stage(spark, got, base)
        if i < 4:
            assert got.columns == docs.columns
            got.write.parquet(f"{base}/stage{i}")
            got = spark.read.parquet(f"{base}/stage{i}")
            left.append({r["doc_id"] for r in got.select("doc_id").collect()})
    n = 300
    assert {n + 2, n + 3, n + 4} & left[0] == set()             # no letter, null, empty
    assert n not in left[1] and n + 1 not in left[1] and 0 in left[1]
    assert n + 5 in left[1] and n + 5 not in left[2]
    clean = [i for i in range(n) if kinds[i] == "good"]
    assert set(clean) <= left[2] and np.mean([i in left[3] for i in clean]) > 0.95
    assert np.mean([i in left[3] for i in range(n) if kinds[i] == "bad"]) < 0.05
    packed = {d for r in got.collect() for d in r["doc_ids"]}
    assert packed == left[3]
    assert cp.run(spark, base).count() == got.count()


def test_pipeline_of_an_empty_table(make_docs, spark, tmp_path):
    import corpus_pipeline as cp

    base = str(tmp_path)
    make_docs([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    assert cp.run(spark, base).count() == 0


def test_slices_cover_all_rows():
    col = pa.array(["a" * 10, None, "", "b" * 100, "c"], pa.string())
    spans = list(W.slices(col, 16))
    assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == 5
