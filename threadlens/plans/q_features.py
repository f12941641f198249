"""Feature queries (M1-M4, M11, R6) with DuckDB oracles."""

from __future__ import annotations


from threadlens.functions import text as T
from threadlens.operators import features as FE
from threadlens.operators import similarity as SI
from threadlens.plans.oracle_sql import with_ctes
from threadlens.plans.q_relational import sql_clean_post
from threadlens.plans.q_text import NEG_SQL, STOP_WORDS, _sql_list, _TOKS
from threadlens.plans.registry import register
from threadlens.session import cut_lineage
from threadlens.sources.forum import ForumTables

MIN_DF = 2
MAX_DF = 0.95
MAX_FEATURES = 1000
TOP_K = 5
TOP_TERMS = 5

_TERMS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_STOP = _sql_list(STOP_WORDS)


def _sql_terms(text: str, stop: bool = True) -> str:
    base = _TERMS.format(t=text)
    return f"list_filter({base}, lambda x: not list_contains({_STOP}, x))" if stop else base


def _sql_tfidf(tf: str, keys: str, documents: str = "documents") -> list[str]:
    """CTEs turning a tf relation (keys, term, tf) into weights ``wt``; N counts all ``documents``."""
    return [
        f"nd as (select count(*) as n from (select distinct {keys} from {documents}) x)",
        f"dfq as (select term, count(*) as df from {tf} group by term)",
        f"wr as (select {tf}.*, {tf}.tf * (ln((1 + nd.n) / (1 + dfq.df)) + 1) as w from {tf} join dfq using (term), nd)",
        f"nr as (select {keys}, sqrt(sum(w * w)) as nrm from wr group by {keys})",
        f"wt as (select {', '.join('wr.' + k.strip() for k in keys.split(','))}, wr.term, wr.tf, round(wr.w / nr.nrm, 6) as weight "
        f"from wr join nr using ({keys}))",
    ]


def _t(spark, sf_dir):
    return ForumTables(spark, sf_dir)


# ---------------------------------------------------------------- M1

M1_SQL = with_ctes("select thread_id, user_id, term, tf, weight from wt", "posts", extra=[
    f"occ as (select thread_id, user_id, unnest({_sql_terms('post_text')}) as term from posts)",
    "tfr as (select thread_id, user_id, term, count(*) as tf from occ group by thread_id, user_id, term)",
] + _sql_tfidf("tfr", "thread_id, user_id", "posts"))


def user_doc_tfidf(posts):
    return FE.tfidf_texts(posts, ["thread_id", "user_id"], "post_text", STOP_WORDS)


@register("m1_tfidf", M1_SQL)
def m1(spark, sf_dir):
    return user_doc_tfidf(_t(spark, sf_dir).posts)


# ---------------------------------------------------------------- M2 / M3 / R6

_DOC_TF = [
    f"docc as (select doc_id, unnest({_sql_terms('text')}) as term from documents)",
    "dtf as (select doc_id, term, count(*) as tf from docc group by doc_id, term)",
]
_VOCAB = _DOC_TF + [
    "ndocs as (select count(*) as n from documents)",
    f"""vocab as (select term, df, cnt, row_number() over (order by term) - 1 as term_index from (
          select term, count(*) as df, sum(tf) as cnt from dtf group by term
          having count(*) >= {MIN_DF} and count(*) <= {MAX_DF} * (select n from ndocs)
          order by cnt desc, term limit {MAX_FEATURES}) v)""",
]


def _doc_tf(spark, sf_dir):
    docs = _t(spark, sf_dir).raw("documents").select("doc_id", "text")
    return FE.counted_terms(docs, ["doc_id"], "text", STOP_WORDS)


def _all_docs(spark, sf_dir):
    return _t(spark, sf_dir).raw("documents").select("doc_id")


def _vocab(tf, documents):
    return FE.vocabulary(tf, ["doc_id"], MIN_DF, MAX_DF, MAX_FEATURES, documents)


@register("m2_vocabulary", with_ctes("select term, df, cnt, term_index from vocab", extra=_VOCAB))
def m2v(spark, sf_dir):
    return _vocab(_doc_tf(spark, sf_dir), _all_docs(spark, sf_dir))


@register("m2_full_vocabulary", with_ctes(
    """select term, count(*) as df, sum(tf)::bigint as cnt, row_number() over (order by term) - 1 as term_index
       from dtf group by term""", extra=_DOC_TF))
def m2f(spark, sf_dir):
    """M2 without a limit: every term of the whole texts, numbered in order."""
    tf = cut_lineage(_doc_tf(spark, sf_dir))
    return FE.vocabulary(tf, ["doc_id"], documents=_all_docs(spark, sf_dir)).select("term", "df", "cnt", "term_index")


@register("m2_count_vectors", with_ctes(
    "select dtf.doc_id, vocab.term_index, dtf.tf from dtf join vocab using (term)", extra=_VOCAB))
def m2c(spark, sf_dir):
    tf = cut_lineage(_doc_tf(spark, sf_dir))
    return FE.restrict(tf, _vocab(tf, _all_docs(spark, sf_dir))).select("doc_id", "term_index", "tf")


M3_CTES = _VOCAB + ["rtf as (select dtf.doc_id, dtf.term, dtf.tf from dtf join vocab using (term))"] + \
    _sql_tfidf("rtf", "doc_id")


def _m3(spark, sf_dir):
    tf = cut_lineage(_doc_tf(spark, sf_dir))
    docs = _all_docs(spark, sf_dir)
    r = FE.restrict(tf, _vocab(tf, docs)).select("doc_id", "term", "tf")
    return FE.tfidf(r, ["doc_id"], documents=docs)


@register("m3_tfidf_limited", with_ctes("select doc_id, term, tf, weight from wt", extra=M3_CTES))
def m3(spark, sf_dir):
    return _m3(spark, sf_dir)


@register("r6_top_terms", with_ctes(
    f"""select doc_id, term, weight, rank from (
          select doc_id, term, weight, row_number() over (partition by doc_id order by weight desc, term) as rank
          from wt) x where rank <= {TOP_TERMS}""", extra=M3_CTES))
def r6(spark, sf_dir):
    return FE.top_terms(_m3(spark, sf_dir), "doc_id", TOP_TERMS).select("doc_id", "term", "weight", "rank")


# ---------------------------------------------------------------- M4

M4_SQL = f"""
with {_TOKS.replace("from documents", f"from (select doc_id, {sql_clean_post('text')} as text from documents) c where text is not null")},
flags as (select *, {NEG_SQL} as neg, regexp_matches(token, '^.*[.:;!?]$') as en from toks),
wn as (select *, max(case when neg then pos end) over (partition by doc_id order by pos
                                                     rows between unbounded preceding and 1 preceding) as ln,
                max(case when en then pos end) over (partition by doc_id order by pos
                                                     rows between unbounded preceding and 1 preceding) as le
      from flags),
marked as (select doc_id, case when ln is not null and (le is null or le < ln) and not neg then token || '_NEG'
                          else token end as tok from wn),
mocc as (select doc_id, unnest({_TERMS.format(t='tok')}) as term from marked),
mtf as (select doc_id, term, count(*) as tf from mocc group by doc_id, term),
{', '.join(_sql_tfidf('mtf', 'doc_id'))}
select doc_id, term, tf, weight from wt"""


@register("m4_negation_tfidf", M4_SQL)
def m4(spark, sf_dir):
    docs = _t(spark, sf_dir).raw("documents").select("doc_id", T.clean_post("text", 4).alias("clean_text"))
    tf = FE.term_counts(FE.negation_terms(docs, "doc_id", "clean_text"), ["doc_id"])
    return FE.tfidf(tf, ["doc_id"], documents=docs)


# ---------------------------------------------------------------- M11

M11_SQL = with_ctes(
    f"""select item_id, doc_id, cosine, rank from (
          select item_id, doc_id, cosine, row_number() over (partition by item_id order by cosine desc, doc_id) as rank
          from (select q.item_id, c.doc_id, round(sum(q.weight * c.weight), 6) as cosine
                from qw q join wt c using (term) group by q.item_id, c.doc_id) s) x
        where rank <= {TOP_K}""",
    extra=_DOC_TF + _sql_tfidf("dtf", "doc_id") + [
        "idf as (select term, ln((1 + nd.n) / (1 + dfq.df)) + 1 as idf from dfq, nd)",
        f"qocc as (select item_id, unnest({_sql_terms('text')}) as term from benchmark)",
        "qtf as (select item_id, term, count(*) as tf from qocc group by item_id, term)",
        "qw0 as (select qtf.item_id, qtf.term, qtf.tf * idf.idf as w from qtf join idf using (term))",
        "qn as (select item_id, sqrt(sum(w * w)) as nrm from qw0 group by item_id)",
        "qw as (select qw0.item_id, qw0.term, round(qw0.w / qn.nrm, 6) as weight from qw0 join qn using (item_id))",
    ])


@register("m11_similar_documents", M11_SQL)
def m11(spark, sf_dir):
    t = _t(spark, sf_dir)
    ctf, docs = cut_lineage(_doc_tf(spark, sf_dir)), _all_docs(spark, sf_dir)
    corpus = FE.tfidf(ctf, ["doc_id"], materialize=False, documents=docs)
    bench = t.raw("benchmark").select("item_id", "text")
    qtf = FE.term_counts(FE.term_occurrences(bench, ["item_id"], "text", STOP_WORDS), ["item_id"])
    queries = FE.tfidf(qtf, ["item_id"], idf_from=ctf, materialize=False, documents=docs)
    return SI.similar_documents(queries, corpus, "item_id", "doc_id", TOP_K)
