from pyspark.sql import functions as F

from threadlens.operators import graph as G
from threadlens.plans.q_graph import thread_graph

POST_COLS = "post_id long, user_id long, user_name string, post_text string, thread_page int, " \
            "post_timestamp timestamp, thread_id long, forum_id int, quoted_post_ids array<long>"


def posts_df(spark, rows):
    import datetime as dt

    full = [(pid, uid, name, "t", 1, dt.datetime(2024, 1, 1, 0, 0, pid % 60), tid, 44, q)
            for pid, uid, name, tid, q in rows]
    return spark.createDataFrame(full, POST_COLS)


def test_cross_thread_quote_vanishes_and_self_loop(spark):
    p = posts_df(spark, [
        (1, 10, "a", 100, []),
        (2, 11, "b", 100, [1]),        # b quotes a (same thread)
        (3, 10, "a", 100, [1]),        # a quotes own post: self-loop
        (4, 12, "c", 200, [1]),        # other thread: vanishes
        (5, 12, "c", 200, [999]),      # unknown post: vanishes
    ])
    e = {tuple(r) for r in G.quote_edges(p).collect()}
    assert e == {(100, 11, 10), (100, 10, 10)}
    v, ue = G.id_graph(p)
    deg = {(r.thread_id, r.node): r.degree for r in G.degrees(v, ue).collect()}
    assert deg[(100, 10)] == 3  # edge to 11 (1) + self-loop (2)
    assert deg[(100, 11)] == 1
    assert deg[(200, 12)] == 0


def test_same_name_merge_before_degree(spark):
    p = posts_df(spark, [
        (1, 1, "x", 1, []),
        (2, 141, "x", 1, [1]),   # different id, same name -> self-loop on 'x'
        (3, 2, "y", 1, [1, 2]),
    ])
    v, e = G.named_graph(p)
    assert sorted(r.node for r in v.collect()) == ["x", "y"]
    assert {(r.u, r.v) for r in e.collect()} == {("x", "x"), ("x", "y")}
    deg = {r.node: r.degree for r in G.degrees(v, e).collect()}
    assert deg == {"x": 3, "y": 1}


def test_degree_sum_is_twice_edges(spark, sf_small):
    from threadlens.sources.forum import ForumTables

    v, e = G.named_graph(ForumTables(spark, sf_small).posts)
    total = G.degrees(v, e).agg(F.sum("degree")).first()[0]
    assert total == 2 * e.count()


def test_degree_cut_is_one_pass(spark):
    # path a-b-c-d: degrees 1,2,2,1; cut at 2 keeps b,c and edge b-c (a k-core would too);
    # star centre s with leaves: cut at 2 keeps s alone and no edges.
    v = spark.createDataFrame([(1, n) for n in "abcd"] + [(2, n) for n in "sxyz"], "thread_id long, node string")
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (2, "s", "x"), (2, "s", "y"), (2, "s", "z")],
                              "thread_id long, u string, v string")
    kept, ke = G.degree_cut(v, e, 2)
    assert sorted((r.thread_id, r.node) for r in kept.collect()) == [(1, "b"), (1, "c"), (2, "s")]
    assert [(r.u, r.v) for r in ke.collect()] == [("b", "c")]


def test_node_link_json_indexes(spark):
    v = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c")], "thread_id long, node string")
    e = spark.createDataFrame([(1, "a", "b")], "thread_id long, u string, v string")
    doc = G.node_link_json(v, e).first().graph_json
    assert doc == ('{"directed":false,"multigraph":false,"nodes":[{"id":"a"},{"id":"b"},{"id":"c"}],'
                   '"links":[{"source":0,"target":1}]}')


def test_components_and_shapes(spark):
    edges = [("t", "a", "b"), ("t", "b", "c"), ("t", "a", "c"),      # triangle
             ("p", "p1", "p2"), ("p", "p2", "p3"),                   # path
             ("q", "q1", "q2"), ("q", "q2", "q3"),                   # same shape as path
             ("s", "s", "s")]                                        # self-loop only
    e = spark.createDataFrame([(1, u, v) for _, u, v in edges], "thread_id long, u string, v string")
    nodes = sorted({x for _, u, v in edges for x in (u, v)} | {"iso"})
    v = spark.createDataFrame([(1, n) for n in nodes], "thread_id long, node string")
    comp = {r.node: r.component for r in G.connected_components(v, e).collect()}
    assert comp["b"] == comp["c"] == "a"
    assert comp["p3"] == "p1" and comp["q3"] == "q1"
    assert comp["iso"] == "iso" and comp["s"] == "s"
    counts = G.component_counts(G.connected_components(v, e)).first().n_components
    assert counts == 5
    shapes = G.shape_classes(G.connected_components(v, e), e).collect()
    by_sig = {r.signature: r for r in shapes}
    path = [r for r in shapes if r.signature.startswith("3|2|")]
    assert len(path) == 1 and path[0].class_size == 2 and path[0].component == "p1"
    assert len(by_sig) == 4


def test_long_path_is_one_component(spark):
    n = 5000
    v = spark.range(n).selectExpr("1L as thread_id", "lpad(id, 5, '0') as node")
    e = spark.range(n - 1).selectExpr("1L as thread_id", "lpad(id, 5, '0') as u", "lpad(id + 1, 5, '0') as v")
    assert G.connected_components(v, e).select("component").distinct().count() == 1


def test_triangles(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "c", "d"), (1, "b", "d"), (2, "a", "b")],
                              "thread_id long, u string, v string")
    assert {r.thread_id: r.n for r in G.triangles(e).groupBy("thread_id").agg({"triangles": "sum"})
            .withColumnRenamed("sum(triangles)", "n").collect()} == {1: 6}
    assert {r.node: r.triangles for r in G.triangles(e).collect()} == {"a": 1, "b": 2, "c": 2, "d": 1}


def test_shapes_with_equal_totals_and_degrees(spark):
    """Seven nodes, seven edges, one triangle and equal degrees, but other degrees at the triangle: two classes."""
    one = ["12", "23", "13", "34", "45", "46", "67"]
    two = ["12", "23", "13", "34", "25", "56", "67"]
    e = spark.createDataFrame([(g, a, b) for g, edges in ((1, one), (2, two), (3, one)) for a, b in edges],
                              "thread_id long, u string, v string")
    v = spark.createDataFrame([(g, str(i)) for g in (1, 2, 3) for i in range(1, 8)], "thread_id long, node string")
    got = sorted((r.thread_id, r.class_size) for r in G.shape_classes(G.connected_components(v, e), e).collect())
    assert got == [(1, 2), (2, 1)]


def test_dot_round_trip(spark, tmpdir_path):
    e = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "thread_id long, u string, v string")
    G.write_dot(e, tmpdir_path + "/dot")
    back = G.read_dot(spark, tmpdir_path + "/dot")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", "b"), (2, "c", "d")]


def test_score_bands_and_visible_links(spark):
    nodes = spark.createDataFrame([(1, "a", "0.9"), (1, "b", "0.5"), (1, "c", "0.1"), (1, "d", "n/a")],
                                  "thread_id long, node string, score string")
    links = spark.createDataFrame([(1, "a", "b", "0.7"), (1, "a", "c", "0.9"), (1, "a", "d", "0.4")],
                                  "thread_id long, u string, v string, score string")
    vis = {(r.u, r.v) for r in G.visible_links(nodes, links, ["high", "mid"]).collect()}
    assert vis == {("a", "b"), ("a", "d")}


def test_thread_graph_single_thread(spark, sf_small):
    from threadlens.sources.forum import ForumTables

    posts = ForumTables(spark, sf_small).posts
    one = thread_graph(posts, thread_id=1000003, min_edges=1).collect()
    assert len(one) == 1 and one[0].thread_id == 1000003
    drawn = thread_graph(posts, None, 1, 50, 42).collect()
    assert len(drawn) == 1
