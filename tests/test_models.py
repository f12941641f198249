import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import features as FE
from threadlens.operators import models as MO
from threadlens.operators import similarity as SI


def test_clustering_scores_match_definitions(spark):
    labels = [0, 0, 0, 1, 1, 1, 2, 2]
    clusters = [0, 0, 1, 1, 1, 2, 2, 2]
    df = spark.createDataFrame(list(zip(labels, clusters)), "label int, cluster int")
    r = MO.clustering_scores(df).first()
    n = len(labels)

    def H(xs):
        from collections import Counter
        return -sum(c / n * math.log(c / n) for c in Counter(xs).values())

    from collections import Counter
    ct = Counter(zip(labels, clusters))
    nk = Counter(clusters)
    nc = Counter(labels)
    hck = -sum(v / n * math.log(v / nk[k]) for (c, k), v in ct.items())
    hkc = -sum(v / n * math.log(v / nc[c]) for (c, k), v in ct.items())
    h = 1 - hck / H(labels)
    c = 1 - hkc / H(clusters)
    comb = lambda x: x * (x - 1) / 2
    A = sum(comb(v) for v in nc.values()); B = sum(comb(v) for v in nk.values())
    S = sum(comb(v) for v in ct.values()); E = A * B / comb(n)
    ari = (S - E) / ((A + B) / 2 - E)
    assert abs(r.homogeneity - round(h, 6)) < 1e-6 and abs(r.completeness - round(c, 6)) < 1e-6
    assert abs(r.v_measure - round(2 * h * c / (h + c), 6)) < 1e-6 and abs(r.adjusted_rand - round(ari, 6)) < 1e-6


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 1, (15, 3)), rng.normal(5, 1, (10, 3)), [[20.0, 20.0, 20.0]]])
    lab = [0] * 15 + [1] * 10 + [2]
    df = spark.createDataFrame([(i, pts[i].tolist(), lab[i]) for i in range(len(lab))], "id long, x array<double>, cluster int")
    got = MO.silhouette_sq(df, "id", "x", "cluster").first().silhouette
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(lab)):
        own = [j for j in range(len(lab)) if lab[j] == lab[i] and j != i]
        if not own:
            s.append(0.0)
            continue
        a = d2[i, own].mean()
        b = min(d2[i, [j for j in range(len(lab)) if lab[j] == k]].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(got - round(float(np.mean(s)), 6)) < 1e-5


def test_naive_bayes_matches_brute_force(spark):
    train = [(1, 0, "a", 2), (1, 0, "b", 1), (2, 0, "a", 1), (3, 1, "c", 3), (3, 1, "b", 1)]
    test = [(10, "a", 1), (10, "c", 1), (11, "c", 2), (12, "zzz", 5)]
    tr = spark.createDataFrame(train, "doc_id long, label int, term string, tf long")
    te = spark.createDataFrame(test, "doc_id long, term string, tf long")
    classes, delta = MO.naive_bayes_fit(tr, "doc_id", "label")
    pred = {r.doc_id: r for r in MO.naive_bayes_predict(te.select("doc_id"), te, classes, delta, "doc_id", "label").collect()}
    vocab = sorted({t for _, _, t, _ in train})
    V = len(vocab)
    for doc in (10, 11, 12):
        scores = {}
        for c in (0, 1):
            docs_c = {d for d, l, _, _ in train if l == c}
            prior = math.log(len(docs_c) / 3)
            tc = sum(tf for _, l, _, tf in train if l == c)
            s = prior
            for d, t, x in test:
                if d == doc and t in vocab:
                    tct = sum(tf for _, l, tt, tf in train if l == c and tt == t)
                    s += x * math.log((tct + 1) / (tc + V))
            scores[c] = s
        best = max(scores, key=lambda c: (scores[c], -c))
        assert pred[doc].predicted == best
        got = {s.label: s.score for s in pred[doc].scores}
        assert all(abs(got[c] - scores[c]) < 1e-9 for c in (0, 1))


def test_nmf_objective_falls_and_factors_nonnegative(spark):
    rng = np.random.default_rng(0)
    X = rng.random((12, 9)) * (rng.random((12, 9)) > 0.5)
    rows = [(i, j, float(X[i, j])) for i in range(12) for j in range(9) if X[i, j] > 0]
    x = spark.createDataFrame(rows, "doc long, term long, value double")
    W, Hf, hist = MO.nmf(x, "doc", "term", "value", k=3, tolerance=1e-2, seed=2)
    assert all(b <= a + 1e-9 for a, b in zip(hist, hist[1:]))
    assert W.where("w < 0").count() == 0 and Hf.where("h < 0").count() == 0


def test_kmeans_recovers_separable_clusters(spark):
    rng = np.random.default_rng(1)
    pts = [(i, (rng.normal(0, 0.1, 2) + (10 * (i % 3))).tolist(), i % 3) for i in range(90)]
    df = spark.createDataFrame(pts, "id long, x array<double>, label int")
    assign, _ = MO.kmeans_dense(df, "id", "x", k=3, max_iter=20, seed=1)
    scores = MO.clustering_scores(assign.join(df, "id"), "label", "cluster").first()
    assert scores.v_measure == 1.0 and scores.adjusted_rand == 1.0


def _text_weights(texts):
    """Normalised TF-IDF rows of token lists, spelled out."""
    from collections import Counter

    df = Counter(t for x in texts for t in set(x))
    out = []
    for x in texts:
        w = {t: c * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, c in Counter(x).items()}
        n = math.sqrt(sum(v * v for v in w.values()))
        out.append({t: v / n for t, v in w.items()})
    return out


def _text_table(spark, texts):
    docs = spark.createDataFrame([(i,) for i in range(len(texts))], "doc_id long")
    return docs, spark.createDataFrame([(i, t) for i, x in enumerate(texts) for t in x], "doc_id long, term string").repartition("doc_id")


def test_kmeans_text_is_lloyd_to_the_end(spark):
    """From the centres the start picked, bounded rounds end where plain Lloyd rounds over dense vectors end."""
    from threadlens.operators import kmeans as KM

    rng = np.random.default_rng(5)
    groups = [[f"g{g}w{i}" for i in range(30)] for g in range(4)]
    texts = [[*rng.choice(groups[i % 4], 12), *rng.choice([f"c{j}" for j in range(40)], 14), f"only{i}"] for i in range(160)]
    texts += [[], texts[0], ["alone"]]
    docs, occ = _text_table(spark, texts)
    rows, idf, state = KM.prepare(docs, occ, "doc_id")
    seeds = KM._candidates(rows, idf, state, 4, 1)
    assert len(set(seeds)) == 4
    w = _text_weights(texts)
    vocab = {t: i for i, t in enumerate(sorted({t for x in w for t in x}))}
    x = np.zeros((len(texts), len(vocab)))
    for i, row in enumerate(w):
        for t, v in row.items():
            x[i, vocab[t]] = v
    c, want = x[seeds], None
    for _ in range(100):
        d = np.round(np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])), 9)
        new = d.argmin(1)
        if want is not None and (new == want).all():
            break
        want = new
        c = np.array([x[want == j].mean(0) if (want == j).any() else np.zeros(len(vocab)) for j in range(4)])
    found, history = KM.fit(rows, idf, state, 4, 100, 0.0, 1)
    got = {r["id"]: r["cluster"] for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == want.tolist()
    assert history[-1]["moved"] == 0 and history[-1]["looked"] < len(texts)
    assert len({got[i] for i in range(160)}) == 4


def _mixed_texts(n):
    rng = np.random.default_rng(7)
    texts = [[*rng.choice([f"g{i % 3}w{j}" for j in range(25)], 10), *rng.choice([f"c{j}" for j in range(60)], 12), f"only{i}"]
             for i in range(n)]
    return texts + [[], texts[0], ["alone", "alone"]]


def test_kmeans_text_rounds_exchange_no_terms(spark):
    """F8: a document is one row, and a round deals out the documents' state, not their terms."""
    from threadlens.operators import kmeans as KM

    texts = _mixed_texts(90)
    docs, occ = _text_table(spark, texts)
    rows, idf, state = KM.prepare(docs, occ, "doc_id")
    assert rows.packed.count() == len(texts)
    named = state.withColumn("a", (F.col("id") % 3).cast("int"))
    sums = KM._sums(rows, idf, named.withColumn("sign", F.lit(1)), 3)
    looked, sent = KM._look(rows, idf, KM._Centres(sums, *KM._members(named), 3), named)
    plan = looked._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") <= 1 and "Bucketed: true" in plan
    got = {r["id"]: r for r in looked.where("slice IS NULL").collect()}
    assert set(got) == set(range(len(texts)))
    w, a = _text_weights([x or ["none"] for x in texts]), {i: i % 3 for i in got}
    w[90] = {}
    centre = [{} for _ in range(3)]
    for i, row in enumerate(w):
        for t, v in row.items():
            centre[a[i]][t] = centre[a[i]].get(t, 0) + v / sum(x == a[i] for x in a.values())
    for i, row in enumerate(w):
        d = [math.sqrt(sum((row.get(t, 0) - c.get(t, 0)) ** 2 for t in {*row, *c})) for c in centre]
        assert abs(got[i]["up"] - min(d)) < 1e-6 and abs(got[i]["low"] - sorted(d)[1]) < 1e-6
    sent.destroy()
    rows.drop()


def test_kmeans_text_terms_beyond_the_sent_ones_count(spark):
    """F8: with only some shared terms numbered, the others are joined and the result is the same."""
    from threadlens.operators import kmeans as KM

    docs, occ = _text_table(spark, _mixed_texts(60))
    want, saved = {r["doc_id"]: r["cluster"] for r in KM.kmeans_terms(docs, occ, "doc_id", k=3).collect()}, KM.SENT_TERMS
    KM.SENT_TERMS = 40
    try:
        rows, idf, state = KM.prepare(docs, occ, "doc_id")
        assert len(idf) == 40 and rows.tail.select("h").distinct().count() > 40
        found, history = KM.fit(rows, idf, state, 3)
    finally:
        KM.SENT_TERMS = saved
    assert {r["id"]: r["cluster"] for r in found.collect()} == want and len(history) > 1


def test_kmeans_text_edge_tables(spark):
    from threadlens.operators import kmeans as KM

    for texts in ([], [[], []], [["a"], ["a"], ["b"]]):
        docs, occ = _text_table(spark, texts)
        got = KM.kmeans_terms(docs, occ, "doc_id", k=8).collect()
        assert len(got) == len(texts)


def test_kmeans_text_query_gives_every_document_a_cluster(spark, sf_small):
    from threadlens.plans import q_models
    from threadlens.plans.q_features import _all_docs

    out = {r["doc_id"]: r["cluster"] for r in q_models.m5t(spark, sf_small).collect()}
    assert set(out) == {r["doc_id"] for r in _all_docs(spark, sf_small).collect()} and set(out.values()) <= set(range(8))


def test_discard_deletes_only_written_tables(spark):
    import os

    from threadlens.session import cut_lineage, discard

    a, b = cut_lineage(spark.range(3)), cut_lineage(spark.range(4))
    discard(a, spark.range(5), b.where("id > 0"))
    folder = lambda t: "/" + t._written_path.replace("file:", "").lstrip("/")
    assert not os.path.exists(folder(a)) and os.path.exists(folder(b)) and b.count() == 4


def test_lda_topic_distributions(spark, sf_small):
    from threadlens.functions import text as T
    from threadlens.sources.forum import ForumTables

    docs = ForumTables(spark, sf_small).raw("documents").select("doc_id", T.terms("text").alias("tokens"))
    topics, dt = MO.lda_topics(docs, "tokens", k=3, max_iter=2, vocab_size=200, n_top=5)
    assert topics.groupBy("topic").count().where("count = 5").count() == 3
    from pyspark.ml.functions import vector_to_array

    sums = dt.select(F.aggregate(vector_to_array("topicDistribution"), F.lit(0.0), lambda a, v: a + v).alias("s"))
    # documents without any vocabulary term get an all-zero distribution
    assert sums.where((F.abs(F.col("s") - 1) > 1e-6) & (F.col("s") != 0)).count() == 0


def test_similarity_matches_brute_force(spark):
    corpus = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry date date")],
                                   "doc_id long, text string")
    queries = spark.createDataFrame([(100, "apple cherry")], "item_id long, text string")
    ctf = FE.term_counts(FE.term_occurrences(corpus, ["doc_id"], "text"), ["doc_id"])
    qtf = FE.term_counts(FE.term_occurrences(queries, ["item_id"], "text"), ["item_id"])
    cw = FE.tfidf(ctf, ["doc_id"])
    qw = FE.tfidf(qtf, ["item_id"], idf_from=ctf)
    got = [(r.doc_id, r.cosine) for r in SI.similar_documents(qw, cw, "item_id", "doc_id", 2).orderBy("rank").collect()]
    vocab = ["apple", "banana", "cherry", "date"]
    tf = np.array([[2, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 2]], float)
    df = (tf > 0).sum(0)
    idf = np.log((1 + 3) / (1 + df)) + 1
    w = tf * idf
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    q = np.array([1, 0, 1, 0]) * idf
    q = q / np.linalg.norm(q)
    cos = np.round(np.round(w, 6) @ np.round(q, 6), 6)
    order = sorted(range(3), key=lambda i: (-cos[i], i))[:2]
    assert got == [(i + 1, float(cos[i])) for i in order]


def _random_weights(spark, seed, n_docs, n_queries, key_text=False):
    """Normalised rows with rare and common terms, exact copies, and documents without a query term."""
    rng = np.random.default_rng(seed)
    words = [f"t{i}" for i in range(400)]
    p = 1 / np.arange(1, 401) ** 0.8
    p /= p.sum()

    def side(n, kind):
        rows = []
        for i in range(n):
            t = sorted(set(rng.choice(words, rng.integers(1, 40), p=p))) if i % 9 else ["t0", "t1"]
            w = rng.integers(1, 5, len(t)) / np.sqrt(np.arange(len(t)) + 1)
            w = np.round(w / np.sqrt((w * w).sum()), 6) if i % 9 else np.array([0.6, 0.8])
            rows += [(f"d{i}" if key_text and kind == "doc_id" else i, a, float(b)) for a, b in zip(t, w)]
        return rows
    c, q = side(n_docs, "doc_id"), side(n_queries, "item_id")
    kt = "string" if key_text else "long"
    return (spark.createDataFrame(q, "item_id long, term string, weight double"),
            spark.createDataFrame(c, f"doc_id {kt}, term string, weight double").repartition(5, "doc_id"), q, c)


def test_similarity_skips_without_losing_rows(spark, monkeypatch):
    """Chunks, blocks of queries, ties and text keys against scoring every pair; most pairs are not scored."""
    from collections import defaultdict

    monkeypatch.setattr(SI, "CHUNK_WEIGHTS", 3000)
    for seed, key_text, k in ((1, False, 5), (2, True, 1), (3, False, 30)):
        queries, corpus, q, c = _random_weights(spark, seed, 1500, 40, key_text)
        by_term, score = defaultdict(list), defaultdict(float)
        for d, t, w in c:
            by_term[t].append((d, w))
        for i, t, w in q:
            for d, v in by_term[t]:
                score[i, d] += w * v
        want = []
        for i in range(40):
            best = sorted(((-round(s, 6), d) for (x, d), s in score.items() if x == i))[:k]
            want += [(i, d, -s, r + 1) for r, (s, d) in enumerate(best)]
        got = SI.similar_documents(queries, corpus, "item_id", "doc_id", k, block_terms=300)
        assert sorted((r[0], r[1], round(r[2], 6), r[3]) for r in got.collect()) == sorted(want)
    assert SI.similar_documents(queries.limit(0), corpus, "item_id", "doc_id", 3).count() == 0
    assert SI.similar_documents(queries, corpus.limit(0), "item_id", "doc_id", 3).count() == 0


def test_similarity_scores_few_pairs_where_a_match_is_near(spark):
    """Queries that are documents but for one term: bounds leave a small part of the pairs that share a term."""
    queries, corpus, _, c = _random_weights(spark, 5, 1500, 1, False)
    rows = [(i, t, w) for i, t, w in c if i % 75 == 1]
    asked = spark.createDataFrame([r for j, r in enumerate(rows) if j % 12], "item_id long, term string, weight double")
    by_doc = {}
    for i, t, _ in c:
        by_doc.setdefault(i, set()).add(t)
    terms = {}
    for j, (i, t, _) in enumerate(rows):
        if j % 12:
            terms.setdefault(i, set()).add(t)
    sharing = sum(bool(ts & own) for ts in terms.values() for own in by_doc.values())
    done = SI.scored_pairs(asked, corpus, "item_id", "doc_id", 1).agg(F.sum("scored")).first()[0]
    assert 0 < done < 0.7 * sharing


@pytest.mark.parametrize("most", [10, 0])
def test_tfidf_of_texts_like_that_of_rows(spark, most):
    """documents of one and of many rows, null keys and texts; no row of (document, term) is shuffled."""
    from threadlens.operators import features as FE

    rows = [(1, 1, "aa bb aa"), (1, 2, "bb cc"), (1, 1, "aa dd the"), (2, 1, None), (2, 2, ""), (None, 3, "aa bb"), (3, 3, "zz")]
    rows += [(9, 9, f"aa w{i % 7} x{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "t long, u int, text string").repartition(3)
    keys = ["t", "u"]
    want = FE.tfidf(FE.term_counts(FE.term_occurrences(df, keys, "text", ["the"]), keys), keys, documents=df)
    saved, FE.MAX_REPEATED = FE.MAX_REPEATED, most
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = FE.tfidf_texts(df, keys, "text", ["the"])
        assert got.dtypes == want.dtypes
        assert sorted(got.collect()) == sorted(want.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(term" not in plan and "MapInArrow" in plan
        assert "Exchange" not in plan[:plan.index("MapInArrow")]
    finally:
        FE.MAX_REPEATED = saved
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


@pytest.mark.parametrize("bits", [64, 3])
def test_tfidf_of_texts_sends_no_words(spark, bits, monkeypatch):
    """a vocabulary beyond what goes out as strings still shuffles no row of (document, term); terms may share a hash."""
    monkeypatch.setattr(FE, "MAX_VOCABULARY", 3)
    rows = [(i % 30, i % 7, f"aa bb{i % 3} cc{i % 11} dd{i % 20} \u00e9\u00e9{i} {'zz ' * (i % 4)}") for i in range(90)]
    df = spark.createDataFrame(rows, "t long, u int, text string").repartition(3)
    keys = ["t", "u"]
    want = FE.tfidf(FE.term_counts(FE.term_occurrences(df, keys, "text"), keys), keys, documents=df)
    got = FE.tfidf_texts(df, keys, "text", **({} if bits == 64 else {"hash_bits": bits}))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "MapInArrow" in plan


def test_counted_terms_like_rows(spark):
    """counts without a shuffle of (document, term), repeated ids and nulls among the documents."""
    rows = [(1, "aa bb aa"), (2, "bb cc"), (1, "aa dd the"), (3, None), (None, "aa"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = FE.term_counts(FE.term_occurrences(df, ["doc_id"], "text", ["the"]), ["doc_id"])
    got = FE.counted_terms(df, ["doc_id"], "text", ["the"])
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "Exchange" not in plan[:plan.index("MapInArrow")]


def test_naive_bayes_meets_the_model_once(spark):
    """one join of the counts with the model, by broadcast, whatever the session's threshold."""
    counts = spark.createDataFrame([(1, 0, "aa", 2), (2, 1, "bb", 1), (2, 1, "aa", 1)], "doc_id long, label int, term string, tf long")
    classes, delta = MO.naive_bayes_fit(counts, "doc_id", "label")
    docs = spark.createDataFrame([(5,), (6,), (7,)], "doc_id long")
    test = spark.createDataFrame([(5, "aa", 3), (6, "bb", 2), (6, "zz", 9)], "doc_id long, term string, tf long")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pred = MO.naive_bayes_predict(docs, test, classes, delta, "doc_id", "label")
        assert "SortMergeJoin [term" not in pred._jdf.queryExecution().executedPlan().toString()
        got = {r["doc_id"]: (r["predicted"], [s["score"] for s in r["scores"]]) for r in pred.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    one = math.log(1 / 2)
    assert got[5][0] == 0 and got[5][1] == pytest.approx([one + 3 * math.log(3 / 4), one + 3 * math.log(2 / 4)])
    assert got[6][0] == 1 and got[6][1] == pytest.approx([one + 2 * math.log(1 / 4), one + 2 * math.log(2 / 4)])
    assert got[7][0] == 0 and got[7][1] == pytest.approx([one, one])


def test_lda_vocabulary_bounds(spark):
    """the vocabulary keeps to its bounds and no token list stays in the tasks' memory."""
    lists = [["aa", "bb"], ["aa", "bb", "bb"], ["aa", "cc"], None, []]
    tokens = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, tokens array<string>")
    found = {r["term"]: (r["df"], r["cnt"]) for r in FE.list_frequencies(tokens, "tokens").collect()}
    assert found == {"aa": (3, 3), "bb": (2, 3), "cc": (1, 1)}
    seen = []
    persist = spark._jsc.getPersistentRDDs().size
    real = FE.list_frequencies
    try:
        MO.list_frequencies = lambda *a: seen.append(a) or real(*a)
        topics, docs = MO.lda_topics(tokens.where("tokens IS NOT NULL"), "tokens", k=2, max_iter=2, min_df=2.0, max_df=0.7)
    finally:
        MO.list_frequencies = real
    assert seen and spark._jsc.getPersistentRDDs().size() == persist()
    assert {r["term"] for r in topics.collect()} == {"bb"}
    assert docs.count() == 4


def test_text_documents_are_dealt_by_number(spark, sf_small):
    """the number of counting tasks follows the number of documents, not their compressed size."""
    from threadlens.operators import kmeans as KM
    from threadlens.plans import q_models as Q

    saved, KM.DOCUMENT_ROWS = KM.DOCUMENT_ROWS, 1
    try:
        docs, occurrences = Q._text_occurrences(spark, sf_small)
        n = max(docs.count(), spark.sparkContext.defaultParallelism)
        assert f", {n}), REPARTITION_BY_NUM" in occurrences._jdf.queryExecution().executedPlan().toString()
    finally:
        KM.DOCUMENT_ROWS = saved
