import duckdb
import pytest

import __spark_entry__ as E

TABLES = ["events", "documents", "pages", "labels", "embeddings", "conversations", "benchmark"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].graph_json.startswith('{"directed":false')


def test_registry_contract():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 130


@pytest.mark.parametrize("name", ["j3_crawl_frontier", "g8_thread_graph", "a8_stat_matrix", "h4_posts_from_pages",
                                  "m10_naive_bayes", "k5_dedupe_latest"])
def test_oracle_at_small_scale(spark, sf_small, name):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts"))
    from check_oracle import digest

    df = E.queries()[name](spark, sf_small)
    srows = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
