"""Model queries (M5-M8, M10).  Exact ones carry DuckDB oracles; iterative ones are rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.operators import features as FE
from threadlens.operators import kmeans as KM
from threadlens.operators import models as MO
from threadlens.operators import relational as R
from threadlens.plans.oracle_sql import with_ctes
from threadlens.plans.q_features import MAX_FEATURES, _DOC_TF, _TERMS, M3_CTES, _all_docs, _doc_tf, _vocab
from threadlens.plans.q_text import STOP_WORDS
from threadlens.plans.registry import register
from threadlens.session import cut_lineage, deal, discard
from threadlens.sources.forum import ForumTables

N_AXES = 8
K_EMB = 10
NB_SEED = 42


def _t(spark, sf_dir):
    return ForumTables(spark, sf_dir)


def _emb(spark, sf_dir):
    return _t(spark, sf_dir).raw("embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


# ---------------------------------------------------------------- M5 / M6

@register("m5_kmeans_embeddings")
def m5(spark, sf_dir):
    return MO.kmeans_dense(_emb(spark, sf_dir), "vec_id", "embedding", k=K_EMB, max_iter=100, seed=1)[0]


@register("m6_kmeans_quality")
def m6k(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    assign = MO.kmeans_dense(emb, "vec_id", "embedding", k=K_EMB, max_iter=100, seed=1)[0]
    return MO.clustering_scores(assign.join(emb.select("vec_id", "label"), "vec_id"), "label", "cluster")


_AXIS = f"""ax as (select vec_id, label, e, list_position(e[1:{N_AXES}], list_max(e[1:{N_AXES}])) - 1 as cluster
               from (select vec_id, label, cast(embedding as double[]) as e from embeddings) x)"""

M6_SQL = f"""
with {_AXIS},
ct as (select label, cluster, count(*)::double as nck from ax group by label, cluster),
c2 as (select *, sum(nck) over (partition by label) as nc, sum(nck) over (partition by cluster) as nk,
              sum(nck) over () as n,
              row_number() over (partition by label order by cluster) = 1 as first_c,
              row_number() over (partition by cluster order by label) = 1 as first_k from ct),
ag as (select -sum(case when first_c then nc / n * ln(nc / n) end) as HC,
              -sum(case when first_k then nk / n * ln(nk / n) end) as HK,
              -sum(nck / n * ln(nck / nk)) as HC_K, -sum(nck / n * ln(nck / nc)) as HK_C,
              sum(nck * (nck - 1) / 2) as S, sum(case when first_c then nc * (nc - 1) / 2 end) as A,
              sum(case when first_k then nk * (nk - 1) / 2 end) as B, max(n * (n - 1) / 2) as N2 from c2),
hc as (select case when HC = 0 then 1.0 else 1 - HC_K / HC end as h,
              case when HK = 0 then 1.0 else 1 - HK_C / HK end as c,
              case when (A + B) / 2 - A * B / N2 = 0 then 1.0 else (S - A * B / N2) / ((A + B) / 2 - A * B / N2) end as ari
       from ag)
select round(h, 6) as homogeneity, round(c, 6) as completeness,
       round(case when h + c = 0 then 0.0 else 2 * h * c / (h + c) end, 6) as v_measure, round(ari, 6) as adjusted_rand
from hc"""


@register("m6_cluster_scores", M6_SQL)
def m6(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    assign = emb.select("label", MO.nearest_axis(emb, "embedding", N_AXES).alias("cluster"))
    return MO.clustering_scores(assign, "label", "cluster")


SIL_SQL = f"""
with {_AXIS},
p as (select vec_id, cluster as k, e as x, list_dot_product(e, e) as xx from ax),
cs as (select k, count(*) as nk, sum(xx) as qk from p group by k),
comp as (select k, i, sum(v) as s from (select k, unnest(x) as v, generate_subscripts(x, 1) as i from p) u group by k, i),
sv as (select k, list(s order by i) as sk from comp group by k),
d as (select p.vec_id, p.k as own, c.k, c.nk, c.nk * p.xx - 2 * list_dot_product(p.x, sv.sk) + c.qk as ssum
      from p cross join cs c join sv on sv.k = c.k),
ab as (select vec_id, max(case when k = own then ssum / (nk - 1) end) as a, max(case when k = own then nk end) as own_n,
              min(case when k <> own then ssum / nk end) as b from d group by vec_id)
select round(avg(case when own_n <= 1 or b is null then 0.0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab"""


@register("m6_silhouette", SIL_SQL)
def m6s(spark, sf_dir):
    emb = _emb(spark, sf_dir)
    pts = emb.select("vec_id", "embedding", MO.nearest_axis(emb, "embedding", N_AXES).alias("cluster"))
    return MO.silhouette_sq(pts, "vec_id", "embedding", "cluster")


def _text_occurrences(spark, sf_dir):
    """All documents, and their term occurrences with a document's rows in one partition."""
    docs = _t(spark, sf_dir).raw("documents").select("doc_id", "text")
    dealt = deal(docs, ["doc_id"], docs.count(), KM.DOCUMENT_ROWS)
    return docs, FE.term_occurrences(dealt, ["doc_id"], "text", STOP_WORDS)


@register("m5_kmeans_text")
def m5t(spark, sf_dir):
    """k-means on the TF-IDF of whole texts: ``(doc_id, cluster)`` of every document."""
    return KM.kmeans_terms(*_text_occurrences(spark, sf_dir), "doc_id", k=8, max_iter=100, seed=1)


# One Lloyd step from the documents of the eight smallest ids as centres.
_STEP = _DOC_TF + [
    "nd as (select count(*) as n from documents)",
    "dfq as (select term, count(*) as df from dtf group by term)",
    "wr as (select doc_id, term, dtf.tf * (ln((1.0 + nd.n) / (1 + dfq.df)) + 1) as w from dtf join dfq using (term), nd)",
    "nr as (select doc_id, sqrt(sum(w * w)) as nrm from wr group by doc_id)",
    "wt as (select doc_id, term, w / nrm as w from wr join nr using (doc_id))",
    """cs as (select doc_id, row_number() over (order by doc_id) - 1 as j from
           (select doc_id from documents order by doc_id limit 8) x)""",
    """dp as (select x.doc_id, cs.j, sum(x.w * c.w) as d from wt x join wt c using (term) join cs on cs.doc_id = c.doc_id
           group by x.doc_id, cs.j)""",
    """ds as (select d.doc_id, cs.j, round(sqrt(greatest(0.0, (case when nr.doc_id is null then 0.0 else 1.0 end)
                  - 2 * coalesce(dp.d, 0) + (case when cn.doc_id is null then 0.0 else 1.0 end))), 6) as dist
           from documents d cross join cs left join nr on nr.doc_id = d.doc_id left join nr cn on cn.doc_id = cs.doc_id
           left join dp on dp.doc_id = d.doc_id and dp.j = cs.j)""",
    """asg as (select doc_id, cast(j as integer) as cluster, dist as distance from (
             select *, row_number() over (partition by doc_id order by dist, j) as r from ds) y where r = 1)""",
]


def _step(spark, sf_dir):
    rows, idf, state = KM.prepare(*_text_occurrences(spark, sf_dir), "doc_id")
    first = [r["id"] for r in state.select("id").orderBy("id").limit(8).collect()]
    return rows, idf, state, KM.lloyd_step(rows, idf, state, first)


@register("m5_lloyd_step", with_ctes("select doc_id, cluster, distance from asg", extra=_STEP))
def m5s(spark, sf_dir):
    rows, _, _, assigned = _step(spark, sf_dir)
    rows.drop()
    return assigned.withColumnRenamed("id", "doc_id")


@register("m5_lloyd_centres", with_ctes("""
    select c.cluster, c.n_docs, round(sqrt(coalesce(q.q, 0)), 6) as norm
    from (select cast(j as integer) as cluster, (select count(*) from asg where cluster = j) as n_docs from cs) c
    left join (select cluster, sum(m * m) as q from (
                 select asg.cluster, wt.term, sum(wt.w) / max(n.n) as m from wt join asg using (doc_id)
                 join (select cluster, count(*) as n from asg group by cluster) n on n.cluster = asg.cluster
                 group by asg.cluster, wt.term) z group by cluster) q using (cluster)""", extra=_STEP))
def m5c(spark, sf_dir):
    rows, idf, state, assigned = _step(spark, sf_dir)
    centres = KM.centre_table(rows, idf, state, cut_lineage(assigned), 8)
    rows.drop()
    return centres.withColumn("norm", F.round("norm", 6))


SAMPLE_SQL = f"""
with {_AXIS},
s as (select vec_id, cluster as k, e as x from ax order by md5('1:' || cast(vec_id as varchar)), vec_id limit {MO.SAMPLE_ROWS}),
d as (select a.vec_id, a.k as own, b.k, list_distance(a.x, b.x) as d from s a join s b on a.vec_id <> b.vec_id),
m as (select vec_id, own, k, avg(d) as m from d group by vec_id, own, k),
ab as (select s.vec_id, min(case when m.k = m.own then m.m end) as a, min(case when m.k <> m.own then m.m end) as b
       from s left join m using (vec_id) group by s.vec_id)
select round(avg(case when a is null or b is null then 0.0 else (b - a) / greatest(a, b) end), 6) as silhouette,
       count(*) as n_rows from ab"""


@register("m6_silhouette_sample", SAMPLE_SQL)
def m6t(spark, sf_dir):
    """Euclidean silhouette on the seeded sample of the table."""
    emb = _emb(spark, sf_dir)
    pts = emb.select("vec_id", "embedding", MO.nearest_axis(emb, "embedding", N_AXES).alias("cluster"))
    return MO.silhouette_sample(pts, "vec_id", "embedding", "cluster")


# ---------------------------------------------------------------- M7 / M8

def _limited_matrix(spark, sf_dir):
    """The limited TF-IDF matrix ``(doc_id, term_index, weight)`` and its vocabulary; the texts are counted once."""
    docs = _all_docs(spark, sf_dir)
    tf = cut_lineage(_doc_tf(spark, sf_dir))
    vocab = cut_lineage(_vocab(tf, docs).select("term", "term_index"))
    kept = cut_lineage(FE.restrict(tf, vocab).select("doc_id", "term", "tf"))
    discard(tf)
    return FE.tfidf(kept, ["doc_id"], materialize=False, documents=docs).join(vocab, "term").select(
        "doc_id", "term_index", "weight"), vocab


@register("m7_nmf_topics")
def m7(spark, sf_dir):
    x, vocab = _limited_matrix(spark, sf_dir)
    _, H, _hist = MO.nmf(x, "doc_id", "term_index", "weight", k=10, alpha=0.1, l1_ratio=0.5, seed=1)
    topics = H.join(vocab, "term_index").select("component", "term", F.round("h", 6).alias("weight"))
    return FE.top_terms(topics, "component", 10)


# One round from fixed factors: w_dj = 1 / (1 + (d + j) % 7), h_jt = 1 / (1 + (t + 2 j) % 5), three components.
_NMF_K, _NMF_L1, _NMF_L2 = 3, 0.05, 0.05
_NMF_CTES = M3_CTES + [
    "xx as (select wt.doc_id as d, vocab.term_index as t, wt.weight as x from wt join vocab using (term))",
    f"w0 as (select d, j, 1.0::double / (1 + (d + j) % 7) as w from (select distinct d from xx) a, range({_NMF_K}) r(j))",
    f"h0 as (select t, j, 1.0::double / (1 + (t + 2 * j) % 5) as h from (select distinct t from xx) a, range({_NMF_K}) r(j))",
    "gw as (select a.j as i, b.j as j, sum(a.w * b.w) as g from w0 a join w0 b using (d) group by a.j, b.j)",
    "nh as (select t, j, sum(x * w) as num from xx join w0 using (d) group by t, j)",
    f"""h1 as (select h0.t, h0.j, h0.h * nh.num / ((select sum(g.g * o.h) from gw g join h0 o on o.t = h0.t and o.j = g.i
             where g.j = h0.j) + {_NMF_L1} + 1e-10 + {_NMF_L2} * h0.h) as h from h0 join nh using (t, j))""",
    "gh as (select a.j as i, b.j as j, sum(a.h * b.h) as g from h1 a join h1 b using (t) group by a.j, b.j)",
    "nw as (select d, j, sum(x * h) as num from xx join h1 using (t) group by d, j)",
    f"""w1 as (select w0.d, w0.j, w0.w * nw.num / ((select sum(g.g * o.w) from gh g join w0 o on o.d = w0.d and o.j = g.i
             where g.j = w0.j) + {_NMF_L1} + 1e-10 + {_NMF_L2} * w0.w) as w from w0 join nw using (d, j))""",
]


@register("m7_nmf_step", with_ctes(
    """select 'term' as side, t as id, cast(j as integer) as component, round(h, 6) as weight from h1
       union all select 'document', d, cast(j as integer), round(w, 6) from w1""", extra=_NMF_CTES))
def m7s(spark, sf_dir):
    """One update of both factors from fixed ones, on the whole limited TF-IDF matrix."""
    x, _ = _limited_matrix(spark, sf_dir)
    ks = range(_NMF_K)
    docs = cut_lineage(MO.nmf_blocks(x, "doc_id", "term_index", "weight").select(
        "d", "xs", *((F.lit(1.0) / (1 + (F.col("d") + j) % 7)).alias(f"w_{j}") for j in ks)))
    terms = docs.select(F.explode("xs.t").alias("t")).distinct().select(
        "t", *((F.lit(1.0) / (1 + (F.col("t") + 2 * j) % 5)).alias(f"h_{j}") for j in ks))
    wtw, _ = MO._gram(docs, [f"w_{j}" for j in ks])
    h = cut_lineage(MO.nmf_term_step(docs, terms, wtw, _NMF_K, _NMF_L1, _NMF_L2))
    hht, _ = MO._gram(h, [f"h_{j}" for j in ks])
    new = MO.nmf_doc_step(docs, h, hht, _NMF_K, _NMF_L1, _NMF_L2)

    def long(table, key, side, p):
        parts = F.array(*(F.struct(F.lit(j).alias("component"), F.round(f"{p}_{j}", 6).alias("weight")) for j in ks))
        return table.select(F.lit(side).alias("side"), F.col(key).cast("long").alias("id"), F.explode(parts).alias("e")).select(
            "side", "id", "e.*")

    return long(h, "t", "term", "h").unionByName(long(new, "d", "document", "w"))


@register("m8_lda_topics")
def m8(spark, sf_dir):
    docs = _t(spark, sf_dir).raw("documents").select("doc_id", T.terms("text", STOP_WORDS).alias("tokens"))
    topics, _ = MO.lda_topics(docs, "tokens", k=10, max_iter=5, vocab_size=MAX_FEATURES, min_df=2.0, max_df=0.95,
                              n_top=10, seed=1)
    return topics


# ---------------------------------------------------------------- M10

def _nb_counts(spark, sf_dir):
    t = _t(spark, sf_dir)
    labels = R.seeded_split(t.raw("labels").select("doc_id", "quality"), "doc_id", "quality", NB_SEED)
    docs = t.raw("documents").select("doc_id", "text")
    labelled = docs.join(labels.withColumnRenamed("quality", "label"), "doc_id").where("label IS NOT NULL")
    counts = cut_lineage(FE.counted_terms(labelled, ["doc_id", "label", "split"], "text"))
    every = docs.select("doc_id").join(labels, "doc_id").withColumnRenamed("quality", "label")
    return counts, every


@register("m10_naive_bayes", f"""
with sp as (select doc_id, quality as label,
                   case when rn <= floor(n / 2) then 'train' else 'test' end as split
            from (select doc_id, quality,
                         row_number() over (partition by quality order by md5('{NB_SEED}:' || cast(doc_id as varchar)), doc_id) as rn,
                         count(*) over (partition by quality) as n from labels) x),
cnt as (select d.doc_id, sp.label, sp.split, d.term, count(*) as tf
        from (select doc_id, unnest({_TERMS.format(t='text')}) as term from documents) d join sp using (doc_id)
        group by d.doc_id, sp.label, sp.split, d.term),
tr as (select * from cnt where split = 'train'),
every as (select sp.* from sp join documents using (doc_id)),
nn as (select count(*) as n from every where split = 'train'),
vv as (select count(distinct term) as v from tr),
classes as (select label, ln(nd / nn.n) as log_prior, ln(1.0 / (tc + vv.v)) as log_zero
            from (select label, count(*) as nd from every where split = 'train' group by label) c
                 join (select label, sum(tf) as tc from tr group by label) s using (label), nn, vv),
delta as (select label, term, ln(sum(tf) + 1.0) as delta from tr group by label, term),
te as (select doc_id, term, tf from cnt where split = 'test' and term in (select term from delta)),
tot as (select doc_id, sum(tf) as n_terms from te group by doc_id),
seen as (select te.doc_id, delta.label, sum(te.tf * delta.delta) as d from te join delta using (term)
         group by te.doc_id, delta.label),
docs as (select doc_id from every where split = 'test'),
sc as (select docs.doc_id, c.label, c.log_prior + c.log_zero * coalesce(tot.n_terms, 0) + coalesce(seen.d, 0) as score
       from docs cross join classes c left join tot on tot.doc_id = docs.doc_id
       left join seen on seen.doc_id = docs.doc_id and seen.label = c.label)
select doc_id, arg_max(label, (score, -label)) as predicted,
       round(max(case when label = 0 then score end), 6) as score_0,
       round(max(case when label = 1 then score end), 6) as score_1
from sc group by doc_id""")
def m10(spark, sf_dir):
    c, every = _nb_counts(spark, sf_dir)
    train = c.where(F.col("split") == "train").select("doc_id", "label", "term", "tf")
    test = c.where(F.col("split") == "test").select("doc_id", "term", "tf")
    classes, delta = MO.naive_bayes_fit(train, "doc_id", "label", documents=every.where(F.col("split") == "train"))
    pred = MO.naive_bayes_predict(every.where(F.col("split") == "test").select("doc_id"), test, classes, delta, "doc_id", "label")

    def score(lbl):
        return F.round(F.filter("scores", lambda s: s["label"] == lbl)[0]["score"], 6)

    return pred.select("doc_id", "predicted", score(0).alias("score_0"), score(1).alias("score_1"))


@register("m10_mllib_naive_bayes")
def m10m(spark, sf_dir):
    t = _t(spark, sf_dir)
    labels = R.seeded_split(t.raw("labels").select("doc_id", "quality"), "doc_id", "quality", NB_SEED)
    docs = t.raw("documents").select("doc_id", T.terms("text").alias("tokens")).join(labels, "doc_id")
    out = MO.naive_bayes_mllib(docs.where(F.col("split") == "train"), docs.where(F.col("split") == "test"),
                               "tokens", "quality")
    return out.select("doc_id", "quality", F.col("prediction").cast("int").alias("predicted"))
