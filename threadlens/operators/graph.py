"""Quote graph of each thread, built as DataFrame joins and aggregates.

Representation: vertices ``(key, node)`` and undirected edges ``(key, u, v)``
with ``u <= v``; ``key`` is the graph id (``thread_id`` for the quote graph).
All threads are processed in one plan; a single thread is a filter on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# ---------------------------------------------------------------- J6 / J7 / G1

def quote_edges(posts: DataFrame, distinct: bool = True) -> DataFrame:
    """Quoting user -> quoted user, same thread only.

    Quotes of unknown posts or of posts in another thread vanish in the inner
    join.  Output ``(thread_id, src, dst)``; ``distinct=False`` keeps one row per
    quote (used to count quotes received).
    """
    q = posts.select("thread_id", F.col("user_id").alias("src"),
                     F.explode("quoted_post_ids").alias("quoted_id"))
    target = posts.select("thread_id", F.col("post_id").alias("quoted_id"),
                          F.col("user_id").alias("dst"))
    e = q.join(target, ["thread_id", "quoted_id"]).select("thread_id", "src", "dst")
    return e.distinct() if distinct else e


def latest_user_names(posts: DataFrame, per_thread: bool = False) -> DataFrame:
    """User id -> display name; the name on the latest post wins."""
    keys = ["thread_id", "user_id"] if per_thread else ["user_id"]
    return posts.groupBy(*keys).agg(
        F.max_by("user_name", F.struct("post_timestamp", "post_id")).alias("user_name"))


def thread_vertices(posts: DataFrame) -> DataFrame:
    """G1 (+J7 per thread): every user who posted in a thread, with the latest name seen there."""
    return latest_user_names(posts, per_thread=True)


# ---------------------------------------------------------------- G2 / G5

def undirected(edges: DataFrame, key: str = "thread_id", src: str = "src", dst: str = "dst") -> DataFrame:
    """Unordered simple edges; self-loops kept."""
    return edges.select(key, F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).distinct()


def named_graph(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relabel user ids to names; users sharing a name merge into one node.

    Returns ``(vertices(thread_id, node), edges(thread_id, u, v))``.
    """
    names = thread_vertices(posts)
    vertices = names.select("thread_id", F.col("user_name").alias("node")).distinct()
    e = quote_edges(posts)
    s = names.select("thread_id", F.col("user_id").alias("src"), F.col("user_name").alias("src_name"))
    d = names.select("thread_id", F.col("user_id").alias("dst"), F.col("user_name").alias("dst_name"))
    named = e.join(s, ["thread_id", "src"]).join(d, ["thread_id", "dst"])
    return vertices, undirected(named, "thread_id", "src_name", "dst_name")


def id_graph(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1 + G2 without relabelling: nodes are user ids."""
    vertices = posts.select("thread_id", F.col("user_id").alias("node")).distinct()
    return vertices, undirected(quote_edges(posts))


# ---------------------------------------------------------------- G3 / G4 / G11 / G13

def degrees(vertices: DataFrame, edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """Degree per node; a self-loop counts 2; isolated nodes get 0."""
    ends = (edges.select(key, F.col("u").alias("node"))
            .unionAll(edges.select(key, F.col("v").alias("node"))))
    deg = ends.groupBy(key, "node").agg(F.count(F.lit(1)).alias("degree"))
    return (vertices.join(deg, [key, "node"], "left")
            .select(key, "node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")))


def degree_cut(vertices: DataFrame, edges: DataFrame, min_degree: int, key: str = "thread_id"
               ) -> tuple[DataFrame, DataFrame]:
    """One pass (not a k-core): drop nodes with degree < min_degree and their edges."""
    if min_degree <= 0:
        return vertices, edges
    kept = degrees(vertices, edges, key).where(F.col("degree") >= min_degree).select(key, "node")
    e = (edges.join(kept.withColumnRenamed("node", "u"), [key, "u"], "left_semi")
         .join(kept.withColumnRenamed("node", "v"), [key, "v"], "left_semi"))
    return kept, e.select(key, "u", "v")


def drop_isolated(vertices: DataFrame, edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """Vertices that touch at least one edge."""
    ends = (edges.select(key, F.col("u").alias("node"))
            .unionAll(edges.select(key, F.col("v").alias("node"))))
    return vertices.join(ends, [key, "node"], "left_semi")


def graph_counts(vertices: DataFrame, edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """Node and edge count per graph."""
    n = vertices.groupBy(key).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.groupBy(key).agg(F.count(F.lit(1)).alias("n_edges"))
    return (n.join(m, key, "full")
            .select(key, F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"),
                    F.coalesce("n_edges", F.lit(0)).alias("n_edges")))


# ---------------------------------------------------------------- G6 / G7

def node_link_exploded(vertices: DataFrame, edges: DataFrame, key: str = "thread_id"
                       ) -> tuple[DataFrame, DataFrame]:
    """G6, row form: nodes get a 0-based index by name; links refer to indexes."""
    w = Window.partitionBy(key).orderBy("node")
    nodes = vertices.select(key, "node", (F.row_number().over(w) - 1).alias("idx"))
    su = nodes.select(key, F.col("node").alias("u"), F.col("idx").alias("source"))
    sv = nodes.select(key, F.col("node").alias("v"), F.col("idx").alias("target"))
    links = edges.join(su, [key, "u"]).join(sv, [key, "v"]).select(key, "u", "v", "source", "target")
    return nodes, links


def node_link_json(vertices: DataFrame, edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """One node-link JSON document per graph ``{directed, multigraph, nodes:[{id}], links:[{source,target}]}``.

    The document is the per-graph output the page script consumes; its size is
    that graph's node and edge count.
    """
    nodes, links = node_link_exploded(vertices, edges, key)
    n = nodes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("ns"))
    lk = links.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("ls"))
    doc = F.to_json(F.struct(
        F.lit(False).alias("directed"),
        F.lit(False).alias("multigraph"),
        F.transform("ns", lambda x: F.struct(x["node"].alias("id"))).alias("nodes"),
        F.coalesce("ls", F.array().cast("array<struct<source:int,target:int>>")).alias("links")))
    return n.join(lk, key, "left").select(key, doc.alias("graph_json"))


def adjacency(edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """G7, row form: both directions, sorted neighbour list per node."""
    both = (edges.select(key, F.col("u").alias("node"), F.col("v").alias("nbr"))
            .unionAll(edges.where(F.col("u") != F.col("v"))
                      .select(key, F.col("v").alias("node"), F.col("u").alias("nbr"))))
    return both.groupBy(key, "node").agg(F.array_sort(F.collect_list("nbr")).alias("neighbours"))


def adjacency_json(edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """Adjacency JSON per node: ``{"id": node, "adj": [neighbours]}``."""
    a = adjacency(edges, key)
    return a.select(key, "node", F.to_json(F.struct(F.col("node").alias("id"),
                                                    F.col("neighbours").alias("adj"))).alias("adjacency_json"))


# ---------------------------------------------------------------- G9 / G10

def neighbours(edges: DataFrame, nodes: DataFrame, key: str = "thread_id") -> DataFrame:
    """For each asked (key, node): itself and every node sharing an edge with it."""
    both = (edges.select(key, F.col("u").alias("node"), F.col("v").alias("nbr"))
            .unionAll(edges.select(key, F.col("v").alias("node"), F.col("u").alias("nbr"))))
    via_edges = both.join(nodes.select(key, "node"), [key, "node"], "left_semi")
    itself = nodes.select(key, "node", F.col("node").alias("nbr"))
    return via_edges.unionByName(itself).distinct()


def has_edges(vertices: DataFrame, edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """Vertices with a flag telling whether any edge touches them."""
    touched = drop_isolated(vertices, edges, key).withColumn("has_edge", F.lit(True))
    return (vertices.join(touched, [key, "node"], "left")
            .select(key, "node", F.coalesce("has_edge", F.lit(False)).alias("has_edge")))


# Score band thresholds used by the graph page.
BAND_HIGH = 0.666
BAND_MID = 0.333
BAND_LOW = 0.0


def score_band(score) -> "F.Column":
    """G10: 'high' >= 0.666, 'mid' >= 0.333, 'low' >= 0, 'any' for missing/non-numeric scores."""
    s = F.col(score) if isinstance(score, str) else score
    num = s.try_cast("double")
    return (F.when(num.isNull(), F.lit("any"))
            .when(num >= BAND_HIGH, F.lit("high"))
            .when(num >= BAND_MID, F.lit("mid"))
            .when(num >= BAND_LOW, F.lit("low"))
            .otherwise(F.lit("below")))


def visible_links(nodes: DataFrame, links: DataFrame, bands: list[str], types: list[str] | None = None,
                  key: str = "thread_id") -> DataFrame:
    """Keep links whose own band and both end nodes' bands are selected ('any' always shows).

    ``nodes(key, node, score)``, ``links(key, u, v, score[, type])``.
    """
    ok = F.col("band").isin(*bands) | (F.col("band") == "any")
    vn = nodes.withColumn("band", score_band("score")).where(ok).select(key, "node")
    lk = links.withColumn("band", score_band("score")).where(ok)
    if types is not None and "type" in links.columns:
        lk = lk.where(F.col("type").isin(*types))
    lk = (lk.join(vn.withColumnRenamed("node", "u"), [key, "u"], "left_semi")
          .join(vn.withColumnRenamed("node", "v"), [key, "v"], "left_semi"))
    return lk.drop("band")


# ---------------------------------------------------------------- G12 connected components

def _symmetric(e: DataFrame, key: str) -> DataFrame:
    e = e.where(F.col("u") != F.col("v")).select(key, "u", "v")
    return e.unionAll(e.select(key, F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _edge_state(e: DataFrame, key: str) -> tuple[int, int]:
    """Number of edges and the sum of their hashes: equal for equal (duplicate-free) edge sets."""
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key, "u", "v").cast("decimal(38,0)")).alias("s")).first()
    return int(r["n"]), int(r["s"] or 0)


def connected_components(vertices: DataFrame, edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """Component label = smallest node reachable, per graph.

    Alternating large-star / small-star rounds (Kiveris et al., 2014) on
    DataFrames; O(log n) rounds in practice.  Each round is cut from lineage
    with a reliable checkpoint in the session's shared checkpoint folder and
    the loop runs until a round changes no edge, with no limit on rounds (the
    driver reads one count and one hash sum per round, never data).
    """
    from threadlens.session import cut_lineage

    e = cut_lineage(_symmetric(edges, key))
    state = _edge_state(e, key)
    while state[0]:
        # large star: every neighbour bigger than u hangs off the smallest node of u's closed neighbourhood
        m = e.groupBy(key, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (e.join(m, [key, "u"]).where(F.col("v") > F.col("u"))
                 .select(key, F.col("v").alias("u"), F.col("m").alias("v")))
        large = _symmetric(large, key)
        # small star: u and its smaller neighbours hang off the smallest of them
        smaller = large.where(F.col("v") < F.col("u"))
        sm = smaller.groupBy(key, "u").agg(F.min("v").alias("m"))
        small = (smaller.join(sm, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(sm.select(key, "u", F.col("m").alias("v"))))
        new = cut_lineage(_symmetric(small, key))
        before, state, e = state, _edge_state(new, key), new
        if state == before:
            break
    label = e.groupBy(key, "u").agg(F.least(F.min("v"), F.first("u")).alias("component"))
    return (vertices.select(key, "node")
            .join(label.withColumnRenamed("u", "node"), [key, "node"], "left")
            .select(key, "node", F.coalesce("component", "node").alias("component")))


def component_counts(components: DataFrame, key: str = "thread_id") -> DataFrame:
    """Number of connected components per graph."""
    return components.groupBy(key).agg(F.countDistinct("component").alias("n_components"))


# ---------------------------------------------------------------- G14 / G15

def triangles(edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """Triangles each node is a corner of: ``(key, node, triangles)``; ``edges`` are simple and undirected.

    Edges point from the end of lower degree to the other one (ties by name), so a node starts at most
    sqrt(2 * edges) of them, and the wedges of a hub are not built. Self-loops are in no triangle.
    """
    e = edges.where(F.col("u") != F.col("v"))
    both = e.select(key, "u", "v").unionAll(e.select(key, F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    deg = both.groupBy(key, "u").agg(F.count(F.lit(1)).alias("d"))
    ranked = (both.join(deg, [key, "u"])
              .join(deg.select(key, F.col("u").alias("v"), F.col("d").alias("dv")), [key, "v"]))
    up = ranked.where((F.col("d") < F.col("dv")) | ((F.col("d") == F.col("dv")) & (F.col("u") < F.col("v"))))
    up = up.select(key, "u", "v")
    wedge = (up.join(up.select(key, "u", F.col("v").alias("w")), [key, "u"]).where(F.col("v") < F.col("w")))
    closed = wedge.join(both.select(key, F.col("u").alias("v"), F.col("v").alias("w")), [key, "v", "w"])
    corners = closed.select(key, F.explode(F.array("u", "v", "w")).alias("node"))
    return corners.groupBy(key, "node").agg(F.count(F.lit(1)).alias("triangles"))


def shape_classes(components: DataFrame, edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """Keep one component per "could be isomorphic" class.

    Signature = (nodes, edges, how many nodes have each (degree, triangles)); two components with different
    signatures are never isomorphic, equal signatures may be.  The representative is the smallest
    (graph, component).
    """
    deg = degrees(components.select(key, "node"), edges, key)
    nodes = (components.join(deg, [key, "node"]).join(triangles(edges, key), [key, "node"], "left")
             .withColumn("triangles", F.coalesce("triangles", F.lit(0))))
    comp_of_u = components.select(key, F.col("node").alias("u"), "component")
    m = edges.join(comp_of_u, [key, "u"]).groupBy(key, "component").agg(F.count(F.lit(1)).alias("n_edges"))
    # The table of invariants has as many entries as there are different pairs, whatever the number of nodes.
    hist = nodes.groupBy(key, "component", "degree", "triangles").agg(F.count(F.lit(1)).alias("c"))
    entry = F.struct("degree", "triangles", "c")
    sig = (hist.groupBy(key, "component")
           .agg(F.sum("c").alias("n_nodes"),
                F.array_join(F.transform(F.sort_array(F.collect_list(entry)),
                                         lambda x: F.concat_ws(":", *(x[f].cast("string") for f in ("degree", "triangles", "c")))),
                             ",").alias("invariants"))
           .join(m, [key, "component"], "left"))
    counts = [F.coalesce(c, F.lit(0)).cast("string") for c in ("n_nodes", "n_edges")]
    sig = sig.withColumn("signature", F.concat_ws("|", *counts, "invariants"))
    return (sig.groupBy("signature")
            .agg(F.min(F.struct(key, "component")).alias("rep"), F.count(F.lit(1)).alias("class_size"))
            .select("signature", F.col(f"rep.{key}").alias(key), F.col("rep.component").alias("component"),
                    "class_size"))


DOT_EDGE = " -- "


def dot_lines(edges: DataFrame, key: str = "thread_id") -> DataFrame:
    """One ``u -- v`` text line per edge (write with ``.write.text`` partitioned by graph)."""
    return edges.select(key, F.concat(F.col("u").cast("string"), F.lit(DOT_EDGE), F.col("v").cast("string")).alias("line"))


def write_dot(edges: DataFrame, path: str, key: str = "thread_id", mode: str = "overwrite", buckets: int = 64) -> None:
    """G15 sink: edge lines behind their graph's key and a tab, one folder per bucket of graphs."""
    lines = dot_lines(edges, key).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"),
        F.concat_ws("\t", F.col(key).cast("string"), "line").alias("value"))
    lines.repartition("bucket").write.mode(mode).partitionBy("bucket").text(path)


def read_dot(spark, path: str, key: str = "thread_id") -> DataFrame:
    """G15 reader: edge lines back to ``(key, u, v)``."""
    df = spark.read.text(path)
    pattern = r"^([^\t]*)\t(.*) -- (.*)$"
    return df.select(F.regexp_extract("value", pattern, 1).cast("bigint").alias(key),
                     F.regexp_extract("value", pattern, 2).alias("u"), F.regexp_extract("value", pattern, 3).alias("v"))
