"""Models over the features (M5-M8, M10): MLlib where it matches, DataFrame algebra where exactness matters.

* k-means (M5) on dense vectors and online LDA (M8) are MLlib estimators; k-means on text is in ``kmeans.py``.
* Cluster quality (M6) is computed from the contingency table and cluster
  sums: no pairwise distances.  Silhouette uses squared Euclidean distance,
  whose per-cluster mean decomposes into sums (the definition MLlib's
  ClusteringEvaluator uses); plain Euclidean would need every pair.
* Naive Bayes (M10) has an exact log-probability form in joins/aggregates
  next to the MLlib estimator.
* NMF (M7) keeps a document's weights beside its entries and a term's weights in one row; a round makes
  no row per (document, component).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlens.operators.features import MAX_VOCABULARY, list_frequencies
from threadlens.session import broadcast_if_small, cut_lineage, discard


# ---------------------------------------------------------------- M5 k-means

def kmeans_dense(df: DataFrame, id_col: str, array_col: str, k: int = 8, max_iter: int = 100, seed: int = 1
                 ) -> tuple[DataFrame, object]:
    """M5 on dense array features: ``(id, cluster)`` plus the fitted model (k-means|| start)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.select(id_col, array_to_vector(F.col(array_col).cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, initMode="k-means||", featuresCol="features",
                   predictionCol="cluster").fit(x)
    return model.transform(x).select(id_col, "cluster"), model


# ---------------------------------------------------------------- M6 cluster quality

def clustering_scores(assign: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """M6: homogeneity, completeness, V-measure and adjusted Rand index in one row.

    Only the contingency table (labels x clusters cells) is aggregated further.
    """
    ct = assign.groupBy(label, cluster).agg(F.count(F.lit(1)).cast("double").alias("nck"))
    total = assign.agg(F.count(F.lit(1)).cast("double")).scalar()
    ct = (ct.withColumn("nc", F.sum("nck").over(Window.partitionBy(label)))
            .withColumn("nk", F.sum("nck").over(Window.partitionBy(cluster)))
            .withColumn("n", total)
            .withColumn("first_c", F.row_number().over(Window.partitionBy(label).orderBy(cluster)) == 1)
            .withColumn("first_k", F.row_number().over(Window.partitionBy(cluster).orderBy(label)) == 1))

    def comb2(c):
        return c * (c - 1) / 2

    agg = ct.agg(
        (-F.sum(F.when(F.col("first_c"), F.col("nc") / F.col("n") * F.log(F.col("nc") / F.col("n"))))).alias("HC"),
        (-F.sum(F.when(F.col("first_k"), F.col("nk") / F.col("n") * F.log(F.col("nk") / F.col("n"))))).alias("HK"),
        (-F.sum(F.col("nck") / F.col("n") * F.log(F.col("nck") / F.col("nk")))).alias("HC_K"),
        (-F.sum(F.col("nck") / F.col("n") * F.log(F.col("nck") / F.col("nc")))).alias("HK_C"),
        F.sum(comb2(F.col("nck"))).alias("S"),
        F.sum(F.when(F.col("first_c"), comb2(F.col("nc")))).alias("A"),
        F.sum(F.when(F.col("first_k"), comb2(F.col("nk")))).alias("B"),
        F.max(comb2(F.col("n"))).alias("N2"))
    h = F.when(F.col("HC") == 0, F.lit(1.0)).otherwise(1 - F.col("HC_K") / F.col("HC"))
    c = F.when(F.col("HK") == 0, F.lit(1.0)).otherwise(1 - F.col("HK_C") / F.col("HK"))
    e = F.col("A") * F.col("B") / F.col("N2")
    ari = F.when((F.col("A") + F.col("B")) / 2 - e == 0, F.lit(1.0)).otherwise(
        (F.col("S") - e) / ((F.col("A") + F.col("B")) / 2 - e))
    out = agg.select(h.alias("h"), c.alias("c"), ari.alias("ari"))
    v = F.when(F.col("h") + F.col("c") == 0, F.lit(0.0)).otherwise(2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c")))
    return out.select(F.round("h", 6).alias("homogeneity"), F.round("c", 6).alias("completeness"),
                      F.round(v, 6).alias("v_measure"), F.round("ari", 6).alias("adjusted_rand"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def silhouette_sq(points: DataFrame, id_col: str, vec: str, cluster: str = "cluster") -> DataFrame:
    """M6: mean silhouette with squared Euclidean distance, exact, via per-cluster sums.

    For a point x and cluster k: sum_j |x - x_j|^2 = n_k |x|^2 - 2 x.S_k + Q_k, with
    S_k the vector sum and Q_k the sum of squared norms.  The per-cluster
    statistics (one row per cluster) enter as a scalar subquery; singletons score 0.
    """
    p = points.select(id_col, F.col(cluster).alias("k"), F.col(vec).cast("array<double>").alias("x"))
    p = p.withColumn("xx", _dot(F.col("x"), F.col("x")))
    # vector sum per cluster, component-wise (partial aggregates, no member lists)
    comp = p.select("k", F.posexplode("x").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("s"))
    svec = comp.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"])
                                 .alias("sk"))
    cs = p.groupBy("k").agg(F.count(F.lit(1)).alias("nk"), F.sum("xx").alias("qk")).join(svec, "k")
    table = cs.select(F.array_sort(F.collect_list(F.struct("k", "nk", "qk", "sk"))).alias("t")).scalar()
    p = p.withColumn("_tbl", table)  # scalar subquery projected first; lambdas read the column
    d = p.select(id_col, "k", F.transform("_tbl", lambda t: F.struct(
        t["k"].alias("k"), t["nk"].alias("nk"),
        (t["nk"] * F.col("xx") - 2 * _dot(F.col("x"), t["sk"]) + t["qk"]).alias("ssum"))).alias("ds"))
    own = F.filter("ds", lambda t: t["k"] == F.col("k"))[0]
    others = F.filter("ds", lambda t: t["k"] != F.col("k"))
    a = own["ssum"] / (own["nk"] - 1)
    b = F.array_min(F.transform(others, lambda t: t["ssum"] / t["nk"]))
    s = F.when((own["nk"] <= 1) | b.isNull(), F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return d.select(F.round(F.avg(s), 6).alias("silhouette"))


def nearest_axis(df: DataFrame, array_col: str, k: int) -> "F.Column":
    """Deterministic clustering: index (0-based) of the largest of the first ``k`` components."""
    head = F.slice(F.col(array_col), 1, k)
    return (F.array_position(head, F.array_max(head)) - 1).cast("int")


# ---------------------------------------------------------------- M8 LDA

def lda_topics(tokens: DataFrame, tokens_col: str, k: int = 10, max_iter: int = 5, vocab_size: int = 1000,
               min_df: float = 2.0, max_df: float = 0.95, n_top: int = 10, seed: int = 1
               ) -> tuple[DataFrame, DataFrame]:
    """M8: online LDA (learning offset 50, decay 0.7) on count vectors.

    The vocabulary is counted in Spark (``list_frequencies``): the estimator keeps all token lists in its tasks.
    ``min_df`` and ``max_df`` of at least 1 are numbers of documents, smaller ones shares.

    Returns ``(topic_terms(topic, rank, term, weight), doc_topics(..., topicDistribution))``;
    the top terms are R6 over ``describeTopics``.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel

    n_docs = tokens.count()
    low, high = (x if x >= 1 else x * n_docs for x in (min_df, max_df))
    words = (list_frequencies(tokens, tokens_col).where((F.col("df") >= low) & (F.col("df") <= high))
             .orderBy(F.desc("cnt"), "term").limit(vocab_size))
    # The vocabulary is at most vocab_size terms.
    vocabulary = [r["term"] for r in words.collect()]
    cv = CountVectorizerModel.from_vocabulary(vocabulary, inputCol=tokens_col, outputCol="features")
    # The vectors are written once; the fit reads them again in every round.
    counts = cut_lineage(cv.transform(tokens).select("features"))
    lda = LDA(k=k, maxIter=max_iter, optimizer="online", learningOffset=50.0, learningDecay=0.7, seed=seed,
              featuresCol="features", topicDistributionCol="topicDistribution")
    model = lda.fit(counts)
    spark = tokens.sparkSession
    vocab = spark.createDataFrame(list(enumerate(vocabulary)), "term_index int, term string")
    topics = model.describeTopics(n_top).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "tw"))
    topics = topics.select("topic", (F.col("pos") + 1).alias("rank"), F.col("tw.termIndices").alias("term_index"),
                           F.col("tw.termWeights").alias("weight"))
    topic_terms = topics.join(F.broadcast(vocab), "term_index").select("topic", "rank", "term", "weight")
    return topic_terms, model.transform(cv.transform(tokens)).drop("features")


# ---------------------------------------------------------------- M10 naive Bayes

def naive_bayes_fit(counts: DataFrame, doc: str, label: str, smoothing: float = 1.0,
                    documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M10 exact multinomial fit from ``(doc, label, term, tf)`` training rows.

    ``documents`` (doc, label) names all training documents, so that those without a term count in the
    priors; by default the documents of ``counts``.

    ``theta_ct = (T_ct + a) / (T_c + a V)`` with V the training vocabulary.
    Returns ``classes(label, log_prior, log_zero)`` (log theta of an unseen
    cell) and ``delta(label, term, delta)`` = log theta_ct - log_zero for seen
    cells only, so no labels x vocabulary grid is ever built.
    """
    docs = (counts if documents is None else documents).select(doc, label).distinct()
    n = docs.agg(F.count(F.lit(1))).scalar()
    v = counts.select("term").distinct().agg(F.count(F.lit(1))).scalar()
    tc = counts.groupBy(label).agg(F.sum("tf").alias("tc"))
    classes = (docs.groupBy(label).agg(F.count(F.lit(1)).alias("nd")).join(tc, label, "left")
               .withColumn("tc", F.coalesce("tc", F.lit(0)))
               .select(label, F.log(F.col("nd") / n).alias("log_prior"),
                       F.log(F.lit(smoothing) / (F.col("tc") + F.lit(smoothing) * v)).alias("log_zero")))
    tct = counts.groupBy(label, "term").agg(F.sum("tf").alias("tct"))
    delta = tct.select(label, "term", F.log((F.col("tct") + smoothing) / F.lit(smoothing)).alias("delta"))
    return classes, delta


def naive_bayes_predict(docs: DataFrame, counts: DataFrame, classes: DataFrame, delta: DataFrame, doc: str,
                        label: str) -> DataFrame:
    """``score_c = log P(c) + sum_t x_t log theta_ct`` over training-vocabulary terms.

    = log P(c) + log_zero_c * (vocabulary terms in the doc) + sum of ``x_t * delta_ct``
    over seen cells.  The class table (one row per class) is a scalar subquery;
    the predicted class is the highest score, ties to the smaller label.
    Output ``(doc, predicted, scores array<struct<label, score>>)``.
    """
    # A term is one row with its labels' deltas, so a document's rows meet the model once, where they lie.
    model = cut_lineage(delta.groupBy("term").agg(F.collect_list(F.struct(label, "delta")).alias("ds")))
    none = F.struct(F.lit(None).cast(dict(delta.dtypes)[label]).alias(label), F.lit(0.0).alias("delta"))
    cells = (counts.join(broadcast_if_small(model, MAX_VOCABULARY), "term")
             .select(doc, "tf", F.explode(F.concat(F.array(none), "ds")).alias("e")))
    sums = cells.groupBy(doc, F.col(f"e.{label}").alias(label)).agg(F.sum("tf").alias("n"),
                                                                    F.sum(F.col("tf") * F.col("e.delta")).alias("d"))
    seen = sums.groupBy(doc).agg(
        F.max(F.when(F.col(label).isNull(), F.col("n"))).alias("n_terms"),
        F.map_from_entries(F.collect_list(F.when(F.col(label).isNotNull(), F.struct(label, "d")))).alias("dm"))
    cls = classes.select(F.array_sort(F.collect_list(F.struct(label, "log_prior", "log_zero"))).alias("c")).scalar()
    j = (docs.select(doc).distinct().join(seen, doc, "left")
         .withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
         .withColumn("_cls", cls))  # scalar subquery projected first; lambdas read the column
    scores = F.transform("_cls", lambda k: F.struct(
        k[label].alias(label),
        (k["log_prior"] + k["log_zero"] * F.col("n_terms")
         + F.coalesce(F.element_at(F.col("dm"), k[label]), F.lit(0.0))).alias("score")))
    j = j.select(doc, scores.alias("scores"))
    best = F.array_max(F.transform("scores", lambda t: F.struct(t["score"].alias("s"), (-t[label]).alias("nl"),
                                                              t[label].alias("l"))))
    return j.select(doc, best["l"].alias("predicted"), "scores")


def naive_bayes_mllib(train: DataFrame, test: DataFrame, tokens_col: str, label: str, num_features: int = 1 << 20):
    """M10 with MLlib: hashed term counts (no term is dropped) + multinomial NaiveBayes (smoothing 1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import HashingTF

    pipe = Pipeline(stages=[
        HashingTF(inputCol=tokens_col, outputCol="features", numFeatures=num_features),
        NaiveBayes(modelType="multinomial", smoothing=1.0, labelCol=label, featuresCol="features"),
    ])
    model = pipe.fit(train.withColumn(label, F.col(label).cast("double")))
    return model.transform(test.withColumn(label, F.col(label).cast("double")))


# ---------------------------------------------------------------- M7 NMF

def _seeded_uniform(seed: int, *cols) -> "F.Column":
    """Deterministic value in [0, 1) from a hash of the seed and the cell coordinates."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.pmod(h, F.lit(1_000_003)).cast("double") / F.lit(1_000_003.0)


def _wide(prefix: str, k: int) -> list[str]:
    return [f"{prefix}_{j}" for j in range(k)]


def _gram(table: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The k x k matrix of products of a factor's columns, and the columns' sums, in one aggregate."""
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = table.agg(*(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs), *(F.sum(c) for c in names)).first()
    g = np.zeros((k, k))
    for (i, j), v in zip(pairs, r):
        g[i, j] = g[j, i] = v or 0.0
    return g, np.array([v or 0.0 for v in r[len(pairs):]])


def _updated(names: list[str], top: list[str], gram: np.ndarray, l1: float, l2: float, eps: float) -> list:
    """x_j * top_j / (sum_i gram_ij x_i + l1 + l2 x_j): a row of a factor after one multiplicative step."""
    out = []
    for j, c in enumerate(names):
        below = sum((F.lit(float(gram[i, j])) * F.col(n) for i, n in enumerate(names)), F.lit(l1 + eps)) + F.lit(l2) * F.col(c)
        out.append((F.col(c) * F.coalesce(top[j], F.lit(0.0)) / below).alias(c))
    return out


def nmf_blocks(x: DataFrame, doc: str, term: str, value: str) -> DataFrame:
    """``(d, xs)``: a document's row of the sparse matrix, as one list of (term, value)."""
    return (x.select(F.col(doc).alias("d"), F.struct(F.col(term).alias("t"), F.col(value).cast("double").alias("x")).alias("e"))
            .groupBy("d").agg(F.collect_list("e").alias("xs")))


def nmf_term_step(docs: DataFrame, h: DataFrame, gram: np.ndarray, k: int, l1: float, l2: float, eps: float = 1e-10) -> DataFrame:
    """H after one step: ``(t, h_0 ..)``. ``docs``: ``(d, xs, w_0 ..)``; ``gram``: that of W.

    A document's weights stand beside its own entries, so W^T X needs no join, and a term's ``k`` sums are one row.
    """
    ws, hs, ns = _wide("w", k), _wide("h", k), _wide("n", k)
    cells = docs.select(F.explode("xs").alias("e"), *ws)
    top = cells.groupBy(F.col("e.t").alias("t")).agg(*(F.sum(F.col("e.x") * F.col(w)).alias(n) for w, n in zip(ws, ns)))
    return h.join(top, "t", "left").select("t", *_updated(hs, ns, gram, l1, l2, eps))


def nmf_doc_step(docs: DataFrame, h: DataFrame, gram: np.ndarray, k: int, l1: float, l2: float, eps: float = 1e-10) -> DataFrame:
    """W after one step, beside the entries, with ``fit``: the document's share of sum(W . X H^T)."""
    ws, hs, ns = _wide("w", k), _wide("h", k), _wide("n", k)
    cells = docs.select("d", F.explode("xs").alias("e")).select("d", F.col("e.t").alias("t"), F.col("e.x").alias("x"))
    top = cells.join(h, "t").groupBy("d").agg(*(F.sum(F.col("x") * F.col(c)).alias(n) for c, n in zip(hs, ns)))
    new = docs.join(top, "d", "left").select("d", "xs", *_updated(ws, ns, gram, l1, l2, eps), *ns)
    fit = sum((F.col(w) * F.coalesce(n, F.lit(0.0)) for w, n in zip(ws, ns)), F.lit(0.0))
    return new.select("d", "xs", *ws, fit.alias("fit"))


def nmf(x: DataFrame, doc: str, term: str, value: str, k: int = 10, alpha: float = 0.1, l1_ratio: float = 0.5,
        tolerance: float = 1e-3, seed: int = 1) -> tuple[DataFrame, DataFrame, list[float]]:
    """M7: minimise 1/2 |X - WH|^2 + a*l1 (|W|_1 + |H|_1) + a*(1-l1)/2 (|W|^2 + |H|^2) by multiplicative updates.

    ``x`` is sparse COO ``(doc, term, value)`` with value >= 0.  The factors are updated in turn, as blocks: a document
    is one row with its entries and its ``k`` weights, a term one row with its ``k`` weights, and only the two
    k x k matrices of products and the objective come to the driver.  A round makes no row per (document, component).
    Rounds go on until one lowers the objective by less than ``tolerance`` of it; a replaced round is deleted.
    """
    docs = cut_lineage(nmf_blocks(x, doc, term, value))
    cells = docs.select(F.explode("xs").alias("e"))
    terms = cut_lineage(cells.select(F.col("e.t").alias("t")).distinct())
    stats = cells.agg(F.sum("e.x").alias("s"), F.sum(F.col("e.x") * F.col("e.x")).alias("xx")).first()
    scale = float(((stats["s"] or 0.0) / max(docs.count() * terms.count(), 1) / k) ** 0.5)
    W = cut_lineage(docs.select("d", "xs", *((_seeded_uniform(seed, F.lit("W"), "d", F.lit(j)) * scale).alias(c)
                                             for j, c in enumerate(_wide("w", k)))))
    H = cut_lineage(terms.select("t", *((_seeded_uniform(seed, F.lit("H"), "t", F.lit(j)) * scale).alias(c)
                                        for j, c in enumerate(_wide("h", k)))))
    discard(docs, terms)
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    wtw, _ = _gram(W, _wide("w", k))
    history: list[float] = []
    while len(history) < 2 or history[-2] - history[-1] > tolerance * abs(history[-2]):
        old, H = H, cut_lineage(nmf_term_step(W, H, wtw, k, l1, l2))
        discard(old)
        hht, h_sum = _gram(H, _wide("h", k))
        old, W = W, cut_lineage(nmf_doc_step(W, H, hht, k, l1, l2))
        discard(old)
        wtw, w_sum = _gram(W, _wide("w", k))
        # |X - WH|^2 = |X|^2 - 2 sum W.(X H^T) + sum (W^T W).(H H^T), zeros of X included
        cross = W.agg(F.sum("fit")).first()[0] or 0.0
        history.append(0.5 * ((stats["xx"] or 0.0) - 2 * cross + float((wtw * hht).sum()))
                       + l1 * float(w_sum.sum() + h_sum.sum()) + 0.5 * l2 * float(np.trace(wtw) + np.trace(hht)))

    def long(table: DataFrame, key: str, name: str, prefix: str, out: str) -> DataFrame:
        parts = F.array(*(F.struct(F.lit(j).alias("component"), F.col(c).alias(out)) for j, c in enumerate(_wide(prefix, k))))
        return table.select(F.col(key).alias(name), F.explode(parts).alias("p")).select(name, "p.component", f"p.{out}")

    return long(W, "d", doc, "w", "w"), long(H, "t", term, "h", "h"), history


# ---------------------------------------------------------------- M6 on the sample

SAMPLE_ROWS, TILE_ROWS = 1000, 100


def silhouette_sample(points: DataFrame, id_col: str, vec: str, cluster: str = "cluster", n: int = SAMPLE_ROWS, seed: int = 1,
                      tile: int = TILE_ROWS) -> DataFrame:
    """M6: mean silhouette with the plain Euclidean distance on the seeded sample (S10) of ``n`` rows.

    The sample is cut into tiles of ``tile`` rows; tile i meets tile j once for i <= j, so no join holds more than
    two tiles and a pair's distance is computed once and counted for both ends. Singletons score 0.
    """
    from threadlens.sources.io import seeded_sample

    rows = seeded_sample(points.select(F.col(id_col).alias("id"), F.col(cluster).alias("k"),
                                       F.col(vec).cast("array<double>").alias("x")), "id", n, seed)
    # At most ``n`` rows are numbered.
    numbered = rows.withColumn("i", F.row_number().over(Window.orderBy("id")) - 1)
    tiles = cut_lineage(numbered.withColumn("tile", F.floor(F.col("i") / tile).cast("int")))
    last = -(-n // tile) - 1
    left = tiles.select("tile", F.explode(F.sequence("tile", F.lit(last))).alias("to"), F.col("i").alias("i"),
                        F.col("k").alias("k_i"), F.col("x").alias("x_i"))
    right = tiles.select(F.col("tile").alias("to"), F.col("i").alias("j"), F.col("k").alias("k_j"), F.col("x").alias("x_j"))
    square = F.aggregate(F.zip_with("x_i", "x_j", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    pairs = left.join(right, "to").where("i < j").select("i", "j", "k_i", "k_j", F.sqrt(square).alias("d"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("k_i").alias("own"), F.col("k_j").alias("k"), "d"),
                                          F.struct(F.col("j").alias("i"), F.col("k_j").alias("own"), F.col("k_i").alias("k"), "d"))).alias("e"))
    mean = ends.select("e.*").groupBy("i", "own", "k").agg(F.avg("d").alias("m"))
    per = mean.groupBy("i").agg(F.min(F.when(F.col("k") == F.col("own"), F.col("m"))).alias("a"),
                                F.min(F.when(F.col("k") != F.col("own"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    every = tiles.select("i").join(per, "i", "left")
    return every.select(F.round(F.avg(F.coalesce(s, F.lit(0.0))), 6).alias("silhouette"), F.count(F.lit(1)).alias("n_rows"))
