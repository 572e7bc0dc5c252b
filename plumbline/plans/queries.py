"""Registered queries over the driver's tables, and the same in SQL, written another way where that is possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions.labels import borehole
from plumbline.operators import clustering, constraints, graph, proximity, similarity
from plumbline.sources import drawing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, for costly narrow steps: a small file is one task otherwise, however many rows it holds."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * cores else df.repartition(4 * cores)


def row_bounded_groups(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("v"), F.floor(F.col("o_totalprice") / 20000).alias("r"))
    out = clustering.row_bounded_groups(o, "v", "r", 2)
    return out.groupBy("v", "island", "chunk").agg(F.min("r").alias("first_row"), F.max("r").alias("last_row"), F.count(F.lit(1)).alias("members"))


def leader_clusters(spark, d):
    out = clustering.leader_clusters(table(spark, d, "events"), ["user_id"], "value", "event_id", 20.0)
    return out.groupBy("user_id", "group_no", "anchor").agg(F.count(F.lit(1)).alias("members"))


def grid_snap(spark, d):
    grid = spark.range(0, 300).select(F.col("id").alias("i"), (F.col("id") * 7.5).alias("v"))
    out = proximity.snap_to_grid(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", grid, "v", "i", 2.0)
    return out.select("p_partkey", F.round("snapped", 6).alias("snapped"))


def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return similarity.cosine_topk(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 3).select("query", "rank", "id", F.round("cosine", 6).alias("cosine"))


def reachable_hops(spark, d):
    n = table(spark, d, "nation")
    links = n.select(F.col("n_nationkey").alias("src"), F.expr("explode(array((n_nationkey * 2 + 1) % 25, (n_nationkey + 7) % 25))").alias("dst"))
    return graph.reachable(links, n.select(F.col("n_nationkey").alias("start")), 4)


def ordered_shift(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("x"))
    p = o.selectExpr("o_custkey", "o_orderkey", "x", "cast(row_number() over (partition by o_custkey order by x, o_orderkey) as int) as n")
    r = p.filter("n > 1").selectExpr("o_custkey", "n as seq", "n - 1 as left_ordinal", "n as right_ordinal", "cast(100 + n as double) as value")
    return constraints.ordered_shift(p, r, "o_custkey", "n", "x").select("o_custkey", "n", F.round("x", 2).alias("x"))


def _balances(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return s, table(spark, d, "customer").select("c_custkey", "c_acctbal")


def nearest_in_tolerance(spark, d):
    s, c = _balances(spark, d)
    return proximity.nearest(s, c, "s_suppkey", "s_acctbal", "c_acctbal", "c_custkey", 30.0, ["c_custkey"]).select("s_suppkey", "c_custkey")


def first_match(spark, d):
    s, c = _balances(spark, d)
    return proximity.first_match(s, c, "s_suppkey", "s_acctbal", "c_acctbal", "c_custkey", 20.0, ["c_custkey"]).select("s_suppkey", "c_custkey")


def far_from_all(spark, d):
    s, c = _balances(spark, d)
    return proximity.far_from_all(c, s, "c_acctbal", "s_acctbal", 10.0).select("c_custkey")


def datum_assign(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 10.0).alias("x"))
    datums = spark.sql("SELECT 1 AS n_regionkey, 300.0D AS value UNION ALL SELECT 3, 450.0D")
    return constraints.datum_assign(n, datums, "n_regionkey", "x", "value").select("n_nationkey", "x")


def orientation(spark, d):
    lo = table(spark, d, "lineitem")
    dx, dy = F.col("l_tax"), F.col("l_discount")
    return lo.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", g.orientation(dx, dy).alias("axis"), g.chebyshev(dx, dy).alias("size"))


def span(spark, d):
    p = table(spark, d, "part")
    s = g.span(F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(25.0), F.lit(1200.0))
    return p.select("p_partkey", s.alias("s")).select("p_partkey", "s.axis", "s.fixed", "s.lo", "s.hi")


def snap_pair(spark, d):
    s, c = _balances(spark, d)
    ends = s.select("s_suppkey", F.col("s_acctbal").alias("y2"), (F.col("s_acctbal") * 0.5).alias("y3"))
    return proximity.snap_dimensions(ends, ("y2", "y3"), c, "c_custkey", "c_acctbal", "c_custkey", 30.0).select("s_suppkey", "row_a", "row_b")


def boundary_snap(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") - 900).alias("y2"), (F.col("p_size") * 25.0).alias("y3"))
    rows = table(spark, d, "nation").select(F.concat(F.lit("Row_"), "n_nationkey").alias("label"), (F.col("n_nationkey") * 40.0 + 100).alias("y"), F.col("n_nationkey").alias("o"))
    edges = table(spark, d, "region").select(F.concat(F.lit("BOUNDARY_"), "r_regionkey").alias("label"), (F.col("r_regionkey") * 300.0).alias("y"), F.col("r_regionkey").alias("o"))
    return proximity.snap_dimensions(p, ("y2", "y3"), rows, "label", "y", "o", 15.0, edges).select("p_partkey", "row_a", "row_b")


def near_pairs(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return proximity.near_pairs(p, "p_partkey", "x", "y", 2.0, digits=6)


def conflicts(spark, d):
    return constraints.conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity")


def triples(spark, d):
    n = graph.triples(table(spark, d, "nation"), "n_nationkey", {"n_name": "name", "n_regionkey": "region"})
    return n.unionByName(graph.triples(table(spark, d, "supplier"), "s_name", {"s_nationkey": "nation"}))


def node_lookup(spark, d):
    t = graph.triples(table(spark, d, "supplier"), "s_suppkey", {"s_name": "name", "s_nationkey": "nation"})
    return graph.lookup(graph.nodes(t, "supplier"), "supplier", nation="3").select("id", "label", F.col("props")["name"].alias("name"))


def label_parse(spark, d):
    p = table(spark, d, "part")
    a, b, t = F.format_string("%.2f", "p_retailprice"), F.format_string("%.1f", F.col("p_retailprice") / 2), F.col("p_size").cast("string")
    label = F.when(F.col("p_partkey") % 2 == 0, F.concat(a, F.lit(" / "), b, F.lit(" ° "), t)).otherwise(F.concat(a, F.lit(" ° "), t, F.lit(" / "), b))
    return p.select("p_partkey", "p_retailprice", borehole(label).alias("h")).select("p_partkey", F.round("h.surface", 2).alias("surface"), F.round("h.thickness", 2).alias("thickness"), (F.abs(F.col("h.floor") - F.col("p_retailprice") / 2) < 0.0501).alias("floor_close"))


def projection_error(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("p"), F.transform(F.slice("embedding", 4, 2), lambda v: v.cast("double")).alias("seen"))
    return e.select("vec_id", F.round(g.projection_error(F.col("seen"), F.col("p"), [[1.0, 0.5, 0.0], [0.0, 1.0, -0.25]]), 9).alias("error"))


def bearing_step(spark, d):
    step = g.bearing_step(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", F.round(step["x"], 6).alias("x"), F.round(step["y"], 6).alias("y"))


def vote(spark, d):
    return similarity.vote(table(spark, d, "events"), "user_id", "event_type")


def obj_lines(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", drawing.vertex_line(F.col("p_retailprice"), F.col("p_size").cast("double"), F.lit(0.0)).alias("line"))


def leader_clusters_as_given(spark, d):
    out = clustering.leader_clusters_as_given(table(spark, d, "events"), ["user_id"], "value", "event_id", 20.0)
    return out.groupBy("user_id", "group_no", "anchor").agg(F.count(F.lit(1)).alias("members"))


def gap_check(spark, d):
    out = clustering.gaps(table(spark, d, "events").select("user_id", "value", "event_id"), ["user_id"], "value", "event_id", 3.0)
    return out.select("event_id", F.round("gap", 6).alias("gap"), "wide")


def column_links(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return clustering.column_links(p, "p_partkey", "x", "y", 1.5, 4.0)


def column_links_in_x(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return clustering.column_links(p, "p_partkey", "x", "y", 1.5, 4.0, between="x")


def segment_distance(spark, d):
    ends = [F.lit(v) for v in (0.0, 0.0, 50.0, 20.0)]
    at = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(g.line_distance(*at, *ends), 6).alias("segment"), F.round(g.line_distance(*at, *ends, infinite=True), 6).alias("line"))


def _segments(spark, d):
    n = table(spark, d, "nation")
    x, y = F.col("n_nationkey") * 60.0 + 900, F.col("n_regionkey") * 10.0
    return n.select(F.col("n_nationkey").alias("entity"), F.col("n_nationkey").alias("ordinal"), x.alias("x1"), y.alias("y1"), (x + 45).alias("x2"), (y + 30).alias("y2"))


def line_reference(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    circles = table(spark, d, "nation").select((F.col("n_nationkey") * 60.0 + 930).alias("x"), (F.col("n_regionkey") * 9.0).alias("y"))
    out = proximity.line_reference(p, "p_partkey", "x", "y", _segments(spark, d), "entity", "ordinal", 20.0, circles, 12.0)
    return out.select("p_partkey", "entity")


def bound_annotations(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("annotation"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"), F.lit("length").alias("kind"), F.col("p_size").alias("value"))
    return constraints.bind_annotations(p, _segments(spark, d), 15.0)


def point_snap(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array("p_retailprice", F.col("p_size").cast("double"), F.lit(7.0)).alias("p"))
    out = p.select("p_partkey", g.snap_point(F.col("p"), [i * 7.5 for i in range(300)], [i * 4.0 for i in range(13)]).alias("p"))
    return out.select("p_partkey", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate("xyz")])


def raw_snap(spark, d):
    grid = [(i * 500.0 - 1000, i * 300.0) for i in range(24)]
    return table(spark, d, "customer").select("c_custkey", F.round(g.snap_raw(F.col("c_acctbal"), grid, 100.0), 6).alias("x"))


def entity_transform(spark, d):
    """Drawing entities as JSON text, read, snapped, written as JSON and read again."""
    price, size = F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit('[{"type":"CIRCLE","handle":"c'), F.col("p_partkey").cast("string"), F.lit('","layer":"L1","attributes":{"center":['), price, F.lit(","), size, F.lit(',7],"radius":'), size, F.lit(',"text":"'), "p_brand", F.lit('"}},'),
        F.lit('{"type":"DIMENSION","handle":"d","attributes":{"defpoint2":['), price, F.lit(',0],"defpoint3":[903,'), size, F.lit('],"measurement":-1,"style":{"a":[1,2]}}},'),
        F.lit('{"type":"INSERT","attributes":{"insert_point":[1,'), size, F.lit('],"attributes":[{"insert":['), price, F.lit(","), size, F.lit('],"tag":"'), "p_brand", F.lit('"}]}}]'),
    )
    entities = drawing.parse_entities(spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")).select(F.col("p_partkey").alias("file"), text.alias("json")), "json")
    snapped = drawing.entity_json(drawing.transform(entities, [i * 7.5 for i in range(300)], [i * 4.0 for i in range(13)])).withColumn("_read", F.parse_json("value"))
    v = F.col("_read")
    read = lambda path, kind: F.try_variant_get(v, path, kind)
    at = F.coalesce(*[read(f"$.attributes.{c}", "array<double>") for c in ("center", "defpoint2", "insert_point")])
    inner = read("$.attributes.attributes[0].insert", "array<double>")
    return snapped.select(
        F.col("file").alias("p_partkey"), "ordinal", read("$.type", "string").alias("type"), read("$.handle", "string").alias("handle"), read("$.layer", "string").alias("layer"), F.round(at[0], 6).alias("x"), F.round(at[1], 6).alias("y"), F.get(at, 2).alias("z"),
        read("$.attributes.radius", "double").alias("radius"), F.coalesce(read("$.attributes.text", "string"), read("$.attributes.attributes[0].tag", "string")).alias("tag"), F.round(inner[0], 6).alias("inner_x"), F.round(inner[1], 6).alias("inner_y"),
        F.round(read("$.attributes.measurement", "double"), 6).alias("measurement"), read("$.attributes.style.a[1]", "int").alias("style"),
    )


def dimension_relations(spark, d):
    circles = table(spark, d, "supplier").select(F.col("s_suppkey").alias("circle_id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 40.0).alias("y"), F.col("s_suppkey").alias("ordinal"))
    size, key = F.col("p_size"), F.col("p_partkey")
    dims = table(spark, d, "part").select(key.cast("string").alias("handle"), F.col("p_retailprice").alias("x2"), (size * 20.0).alias("y2"), (F.col("p_retailprice") + size * 30.0 - 700).alias("x3"), (size * 20.0 + key % 7 * 100 - 300).alias("y3"), size.cast("double").alias("value"))
    lines = table(spark, d, "nation").select((F.col("n_nationkey") * 100.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("n_nationkey") * 100.0).alias("x2"), F.lit(500.0).alias("y2"), F.col("n_nationkey").alias("ordinal"))
    return constraints.resolve_dimensions(dims, circles, lines=lines)


def distance_edges(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("from"), F.col("l_partkey").cast("string").alias("to"), F.col("l_quantity").alias("value"))
    return graph.edges(li)


def redundant(spark, d):
    return constraints.redundant(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity")


def measurement_conflicts(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax", "l_discount")
    out = constraints.measurement_conflicts(li, "l_tax", "l_discount", "l_tax", 0.015)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "actual")


def beside(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return proximity.beside(p, "p_partkey", "x", "y", 1.5).select("a", "b", "side")


def datum_translate(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 10.0).alias("x"))
    datums = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("ref")).withColumn("value", F.col("n_regionkey") * 300.0)
    return constraints.datum_assign(n, datums, "n_regionkey", "x", "value", "translate", "ref", "n_nationkey").select("n_nationkey", "x")


def open_hops(spark, d):
    n = table(spark, d, "nation")
    links = n.select(F.col("n_nationkey").alias("src"), F.explode(F.array((F.col("n_nationkey") * 2 + 1) % 25, (F.col("n_nationkey") + 7) % 25)).alias("dst")).withColumn("open", F.col("dst") % 4 != 0)
    return graph.reachable(links, n.select(F.col("n_nationkey").alias("start")), 12, "open")


def _offsets(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.floor(F.col("c_custkey") / 8).alias("src"), F.col("c_custkey").alias("dst"), F.col("c_acctbal").alias("value"))


def solved_offsets(spark, d):
    out = constraints.solve_offsets(_offsets(spark, d), spark.sql("SELECT 0L AS node, 0.0D AS x"))
    return out.select("node", F.round("x", 4).alias("x"), "hops")


def offset_conflicts(spark, d):
    e = _offsets(spark, d)
    more = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 8).alias("src"), F.col("c_custkey").alias("dst"), (F.col("c_acctbal") + F.col("c_nationkey") % 2).alias("value"))
    solved = constraints.solve_offsets(e, spark.sql("SELECT 0L AS node, 0.0D AS x"))
    return constraints.offset_conflicts(more, solved, 0.5).select("src", "dst", F.round("value", 2).alias("value"), F.round("actual", 2).alias("actual"))


def solved_grid(spark, d):
    n = table(spark, d, "nation")
    lines = n.select("n_name", (F.col("n_nationkey") * 61.7).alias("raw"), F.col("n_name").alias("label")).select("label", "raw")
    edges = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("src")).join(n.select((F.col("n_nationkey") - 1).alias("k"), F.col("n_name").alias("dst"), F.col("n_nationkey").alias("t")), "k").filter("t % 11 <> 10")
    out = constraints.solve_grid(lines, edges.select("src", "dst", (F.col("k") % 3 * 50.0 + 300).alias("value")))
    return out.select("label", F.round("raw", 6).alias("raw"), "solved")


def aligned_sources(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 40.0).alias("y"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 40.0).alias("y"))
    return proximity.align_sources({"drawing": s, "text": c}, "k", "x", "y", 200.0)


def contour_surface(spark, d):
    contours = table(spark, d, "part").select(F.array(F.array("p_retailprice", F.col("p_size") * 10.0), F.array(F.col("p_retailprice") + 5, F.col("p_size") * 10.0)).alias("points"), (F.col("p_size") * 1.5 + 500).alias("elevation"))
    targets = spark.range(0, 400).select((F.col("id") % 20 * 50.0 + 900).alias("x"), (F.floor(F.col("id") / 20) * 25.0).alias("y"))
    return proximity.surface(proximity.contour_points(contours), targets, 40.0).select("x", "y", F.round("elevation", 5).alias("elevation"), "n")


def fitted_line(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("u"), (F.col("p_retailprice") / 1000).alias("v"))
    a, b = constraints.minimise(p, lambda m: [F.lit(m[0]) + F.lit(m[1]) * F.col("u") - F.col("v")], [0.0, 0.0])
    return spark.createDataFrame([("intercept", round(a, 6)), ("slope", round(b, 6))], "name string, value double")


def _views(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("hole"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("n"))
    top = c.filter("hole % 5 <> 4").select("hole", F.col("v").alias("x"), F.col("n").alias("y"))
    front = c.filter("hole % 7 <> 6").select("hole", (F.col("v") + F.when(F.col("hole") % 3 == 0, 2.0).otherwise(0.25)).alias("x"), (F.col("n") * 2).alias("z"))
    left = c.filter("hole % 4 <> 3").select("hole", F.col("n").alias("y"), (F.col("n") * 2 + F.col("hole") % 2).alias("z"))
    return {"top": top, "front": front, "left": left}


def hole_coordinates(spark, d):
    out = constraints.hole_coordinates(_views(spark, d), "hole", 1.0)
    return out.select("hole", *[F.round(c, 2).alias(c) for c in "xyz"])


def reconciled_views(spark, d):
    return constraints.reconcile_views(_views(spark, d), "hole", 1.0).select("hole", "views", "consistent", F.round("x_gap", 2).alias("x_gap"), F.round("z_gap", 2).alias("z_gap"))


QUERIES = {
    f.__name__: f
    for f in (
        row_bounded_groups, leader_clusters, leader_clusters_as_given, gap_check, column_links, column_links_in_x, grid_snap, point_snap, raw_snap, entity_transform, cosine_topk, vote, reachable_hops, open_hops,
        ordered_shift, nearest_in_tolerance, first_match, far_from_all, line_reference, bound_annotations, datum_assign, datum_translate, orientation, span, segment_distance, snap_pair, boundary_snap, near_pairs, beside,
        dimension_relations, distance_edges, conflicts, redundant, measurement_conflicts, solved_offsets, offset_conflicts, solved_grid, aligned_sources, contour_surface, fitted_line, hole_coordinates, reconciled_views,
        triples, node_lookup, label_parse, projection_error, bearing_step, obj_lines,
    )
}

ORACLE_SQL = {
    "row_bounded_groups": """
        WITH o AS (SELECT o_custkey AS v, CAST(floor(o_totalprice / 20000) AS BIGINT) AS r FROM orders),
        k AS (SELECT DISTINCT v, r FROM o),
        i AS (SELECT v, r, r - row_number() OVER (PARTITION BY v ORDER BY r) AS island FROM k),
        c AS (SELECT v, r, island, CAST(floor((r - min(r) OVER (PARTITION BY v, island)) / 2.0) AS BIGINT) AS chunk FROM i)
        SELECT v, island, chunk, min(r) AS first_row, max(r) AS last_row, count(*) AS members FROM o JOIN c USING (v, r) GROUP BY v, island, chunk""",
    "leader_clusters": """
        WITH RECURSIVE a AS (
          SELECT user_id, 1 AS group_no, min(value) AS anchor FROM events GROUP BY user_id
          UNION ALL
          SELECT a.user_id, a.group_no + 1, (SELECT min(e.value) FROM events e WHERE e.user_id = a.user_id AND e.value - a.anchor >= 20)
          FROM a WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND e.value - a.anchor >= 20))
        SELECT a.user_id, a.group_no, a.anchor, count(*) AS members FROM a JOIN events e ON e.user_id = a.user_id AND e.value >= a.anchor AND e.value - a.anchor < 20
        GROUP BY a.user_id, a.group_no, a.anchor""",
    "grid_snap": """
        WITH grid AS (SELECT i, i * CAST(7.5 AS DOUBLE) AS v FROM range(300) t(i)),
        b AS (SELECT p_partkey, any_value(p_retailprice) AS x, min({'d': abs(p_retailprice - v), 'i': i, 'v': v}) AS m FROM part, grid GROUP BY p_partkey)
        SELECT p_partkey, round(CASE WHEN m.d <= 2 THEN m.v ELSE x END, 6) AS snapped FROM b""",
    "cosine_topk": """
        WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS c FROM u q, u v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM s)
        SELECT query, CAST(rank AS INT) AS rank, id, round(c, 6) AS cosine FROM r WHERE rank <= 3""",
    "reachable_hops": """
        WITH RECURSIVE l AS (SELECT n_nationkey AS src, unnest([(n_nationkey * 2 + 1) % 25, (n_nationkey + 7) % 25]) AS dst FROM nation),
        w AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS hops FROM nation
          UNION SELECT w.start, l.dst, w.hops + 1 FROM w JOIN l ON l.src = w.node WHERE w.hops < 4)
        SELECT start, node, min(hops) AS hops FROM w GROUP BY start, node""",
    "ordered_shift": """
        WITH p AS (SELECT o_custkey, o_totalprice AS x, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INT) AS n FROM orders)
        SELECT o_custkey, n, round(first_value(x) OVER w + coalesce(sum(CASE WHEN n > 1 THEN 100 + n ELSE 0 END) OVER w, 0), 2) AS x FROM p
        WINDOW w AS (PARTITION BY o_custkey ORDER BY n)""",
    "nearest_in_tolerance": """
        SELECT s_suppkey, (SELECT arg_min(c_custkey, {'d': abs(c_acctbal - s_acctbal), 'k': c_custkey}) FROM customer WHERE abs(c_acctbal - s_acctbal) < 30) AS c_custkey FROM supplier""",
    "first_match": """
        SELECT s_suppkey, min(c_custkey) AS c_custkey FROM supplier LEFT JOIN customer ON abs(c_acctbal - s_acctbal) < 20 GROUP BY s_suppkey""",
    "far_from_all": """
        SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE abs(c_acctbal - s_acctbal) < 10)""",
    "datum_assign": """
        SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN CAST(300 AS DOUBLE) WHEN 3 THEN CAST(450 AS DOUBLE) ELSE n_nationkey * CAST(10 AS DOUBLE) END AS x FROM nation""",
    "orientation": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN abs(l_tax) > abs(l_discount) THEN 'horizontal' ELSE 'vertical' END AS axis,
        CASE WHEN abs(l_tax) >= abs(l_discount) THEN abs(l_tax) ELSE abs(l_discount) END AS size FROM lineitem""",
    "span": """
        WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, abs(1200 - p_retailprice) < abs(25 - p_size) AS flat FROM part)
        SELECT p_partkey, CASE WHEN flat THEN 'horizontal' ELSE 'vertical' END AS axis, CASE WHEN flat THEN y ELSE x END AS fixed,
        CASE WHEN flat THEN least(x, 25) ELSE least(y, 1200) END AS lo, CASE WHEN flat THEN greatest(x, 25) ELSE greatest(y, 1200) END AS hi FROM p""",
    "snap_pair": """
        SELECT s_suppkey, (SELECT arg_min(c_custkey, {'d': abs(c_acctbal - s_acctbal), 'k': c_custkey}) FROM customer WHERE abs(c_acctbal - s_acctbal) < 30) AS row_a,
        (SELECT arg_min(c_custkey, {'d': abs(c_acctbal - s_acctbal * CAST(0.5 AS DOUBLE)), 'k': c_custkey}) FROM customer WHERE abs(c_acctbal - s_acctbal * CAST(0.5 AS DOUBLE)) < 30) AS row_b FROM supplier""",
    "boundary_snap": """
        WITH r AS (SELECT 0 AS k, n_nationkey AS o, 'Row_' || n_nationkey AS label, n_nationkey * CAST(40 AS DOUBLE) + 100 AS y FROM nation
          UNION ALL SELECT 1, r_regionkey, 'BOUNDARY_' || r_regionkey, r_regionkey * CAST(300 AS DOUBLE) FROM region),
        p AS (SELECT p_partkey, p_retailprice - 900 AS y2, p_size * CAST(25 AS DOUBLE) AS y3 FROM part)
        SELECT p_partkey, (SELECT arg_min(label, {'d': abs(y - y2), 'k': k, 'o': o}) FROM r WHERE abs(y - y2) < 15) AS row_a, (SELECT arg_min(label, {'d': abs(y - y3), 'k': k, 'o': o}) FROM r WHERE abs(y - y3) < 15) AS row_b FROM p""",
    "leader_clusters_as_given": """
        WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        a AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS anchors FROM events
          UNION ALL
          SELECT a.user_id, e.n, CASE WHEN len(list_filter(a.anchors, lambda x: abs(x - e.value) < 20)) > 0 THEN a.anchors ELSE list_append(a.anchors, e.value) END FROM a JOIN e ON e.user_id = a.user_id AND e.n = a.n + 1),
        f AS (SELECT user_id, arg_max(anchors, n) AS anchors FROM a GROUP BY user_id),
        m AS (SELECT e.user_id, e.value, f.anchors, list_position(list_transform(f.anchors, lambda x: abs(x - e.value) < 20), true) AS group_no FROM e JOIN f USING (user_id))
        SELECT user_id, group_no, anchors[group_no] AS anchor, count(*) AS members FROM m GROUP BY ALL""",
    "gap_check": """
        WITH g AS (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS gap FROM events)
        SELECT event_id, round(gap, 6) AS gap, coalesce(gap > 3, false) AS wide FROM g""",
    "column_links": """
        WITH p AS (SELECT p_partkey AS k, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part),
        j AS (SELECT a.k AS a, a.y AS ay, min({'y': b.y, 'k': b.k}) AS n FROM p a JOIN p b ON abs(a.x - b.x) < 1.5 AND (b.y > a.y OR b.y = a.y AND b.k > a.k) GROUP BY a.k, a.y)
        SELECT a, n.k AS b, n.y - ay AS gap FROM j WHERE n.y - ay < 4""",
    "column_links_in_x": """
        WITH p AS (SELECT p_partkey AS k, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y, dense_rank() OVER (ORDER BY p_retailprice) AS r FROM part)
        SELECT a.k AS a, b.k AS b, b.y - a.y AS gap FROM p a JOIN p b ON abs(a.r - b.r) <= 1 AND abs(a.x - b.x) < 1.5 AND (b.y > a.y OR b.y = a.y AND b.k > a.k) AND b.y - a.y < 4""",
    "segment_distance": """
        WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, (p_size * 50 + p_retailprice / 100 * 20) / 2900 AS t FROM part)
        SELECT p_partkey, round(sqrt((x - 50 * greatest(0, least(1, t))) ** 2 + (y - 20 * greatest(0, least(1, t))) ** 2), 6) AS segment, round(abs(50 * y - 20 * x) / sqrt(CAST(2900 AS DOUBLE)), 6) AS line FROM p""",
    "line_reference": """
        WITH l AS (SELECT n_nationkey AS entity, n_nationkey * CAST(60 AS DOUBLE) + 900 AS x1, n_regionkey * CAST(10 AS DOUBLE) AS y1 FROM nation),
        m AS (SELECT p_partkey, entity, x1, y1, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y, greatest(0, least(1, ((p_retailprice - x1) * 45 + (p_size - y1) * 30) / 2925)) AS t FROM part, l)
        SELECT p_partkey, min(entity) AS entity FROM m WHERE sqrt((x - x1 - 45 * t) ** 2 + (y - y1 - 30 * t) ** 2) < 20
        AND NOT EXISTS (SELECT 1 FROM nation WHERE sqrt((m.x - n_nationkey * 60 - 930) ** 2 + (m.y - n_regionkey * 9) ** 2) < 12) GROUP BY p_partkey""",
    "bound_annotations": """
        WITH l AS (SELECT n_nationkey AS entity, n_nationkey * CAST(60 AS DOUBLE) + 900 AS x1, n_regionkey * CAST(10 AS DOUBLE) AS y1 FROM nation),
        m AS (SELECT p_partkey, entity, p_retailprice - x1 AS dx, p_size - y1 AS dy, greatest(0, least(1, ((p_retailprice - x1) * 45 + (p_size - y1) * 30) / 2925)) AS t FROM part, l),
        b AS (SELECT p_partkey, arg_min(entity, {'d': sqrt((dx - 45 * t) ** 2 + (dy - 30 * t) ** 2), 'e': entity}) AS entity FROM m WHERE sqrt((dx - 45 * t) ** 2 + (dy - 30 * t) ** 2) < 15 GROUP BY p_partkey)
        SELECT p_partkey AS annotation, entity, 'length' AS kind, p_size AS value FROM part LEFT JOIN b USING (p_partkey)""",
    "point_snap": """
        WITH s AS (SELECT p_partkey, p_retailprice AS x, round(p_retailprice / 7.5) * 7.5 AS gx, CAST(p_size AS DOUBLE) AS y, least(floor((p_size + 1) / 4.0), 12) * 4 AS gy FROM part)
        SELECT p_partkey, round(CASE WHEN abs(x - gx) <= 2 THEN gx ELSE x END, 6) AS x, CASE WHEN abs(y - gy) <= 2 THEN gy ELSE y END AS y, CAST(7 AS DOUBLE) AS z FROM s""",
    "raw_snap": """
        WITH s AS (SELECT c_custkey, c_acctbal AS x, least(23, greatest(0, ceil((c_acctbal + 1000) / 500 - CAST(0.5 AS DOUBLE)))) AS i FROM customer)
        SELECT c_custkey, round(CASE WHEN abs(x - (i * 500 - 1000)) <= 100 THEN i * 300 ELSE x END, 6) AS x FROM s""",
    "entity_transform": """
        WITH s AS (SELECT *, round(p_retailprice / 7.5) * 7.5 AS gx, least(floor((p_size + 1) / 4.0), 12) * 4 AS gy FROM part),
        t AS (SELECT p_partkey, p_brand, p_size, round(CASE WHEN abs(p_retailprice - gx) <= 2 THEN gx ELSE p_retailprice END, 6) AS x, CAST(CASE WHEN abs(p_size - gy) <= 2 THEN gy ELSE p_size END AS DOUBLE) AS y FROM s)
        SELECT p_partkey, 0 AS ordinal, 'CIRCLE' AS type, 'c' || p_partkey AS handle, 'L1' AS layer, x, y, CAST(7 AS DOUBLE) AS z, CAST(p_size AS DOUBLE) AS radius, p_brand AS tag, CAST(NULL AS DOUBLE) AS inner_x, CAST(NULL AS DOUBLE) AS inner_y,
          CAST(NULL AS DOUBLE) AS measurement, CAST(NULL AS INT) AS style FROM t
        UNION ALL SELECT p_partkey, 1, 'DIMENSION', 'd', NULL, x, 0, NULL, NULL, NULL, NULL, NULL, round(greatest(abs(903 - x), y), 6), 2 FROM t
        UNION ALL SELECT p_partkey, 2, 'INSERT', NULL, NULL, 0, y, NULL, NULL, p_brand, x, y, NULL, NULL FROM t""",
    "dimension_relations": """
        WITH c AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * CAST(40 AS DOUBLE) AS y FROM supplier),
        l AS (SELECT n_nationkey * CAST(100 AS DOUBLE) AS x FROM nation),
        d AS (SELECT CAST(p_partkey AS VARCHAR) AS handle, p_retailprice AS x2, p_size * CAST(20 AS DOUBLE) AS y2, p_retailprice + p_size * CAST(30 AS DOUBLE) - 700 AS x3, p_size * CAST(20 AS DOUBLE) + p_partkey % 7 * 100 - 300 AS y3, CAST(p_size AS DOUBLE) AS value FROM part),
        e AS (SELECT handle, 2 AS e, x2 AS x, y2 AS y, abs(y3 - y2) < abs(x3 - x2) AS flat FROM d UNION ALL SELECT handle, 3, x3, y3, abs(y3 - y2) < abs(x3 - x2) FROM d),
        f AS (SELECT handle, e, flat, CASE WHEN flat THEN x ELSE y END AS pos,
          EXISTS (SELECT 1 FROM l WHERE sqrt((e.x - l.x) ** 2 + (e.y - greatest(0, least(500, e.y))) ** 2) < 20) AND NOT EXISTS (SELECT 1 FROM c WHERE sqrt((e.x - c.x) ** 2 + (e.y - c.y) ** 2) < 30) AS datum,
          (SELECT arg_min({'id': c.id, 'along': CASE WHEN e.flat THEN c.x ELSE c.y END}, {'d': CASE WHEN e.flat THEN abs(c.y - e.y) ELSE abs(c.x - e.x) END, 'id': c.id}) FROM c WHERE CASE WHEN e.flat THEN abs(c.y - e.y) ELSE abs(c.x - e.x) END < 30) AS c FROM e),
        h AS (SELECT handle, e, flat, pos, datum, CASE WHEN datum THEN NULL ELSE c.id END AS c, c.along AS along FROM f),
        p AS (SELECT d.handle, d.value, a.flat, a.datum AS da, b.datum AS db, a.c AS ca, b.c AS cb, a.pos AS pa, b.pos AS pb, a.along AS la, b.along AS lb,
          CASE WHEN a.datum AND b.c IS NOT NULL OR b.datum AND a.c IS NOT NULL THEN 'datum' WHEN a.c <> b.c THEN 'between_circles' ELSE 'unresolved' END AS type FROM d JOIN h a ON a.handle = d.handle AND a.e = 2 JOIN h b ON b.handle = d.handle AND b.e = 3)
        SELECT handle, CASE WHEN flat THEN 'x' ELSE 'y' END AS axis, type, value, CASE WHEN type = 'datum' THEN coalesce(ca, cb) END AS row_ref_circle,
          CASE WHEN type = 'datum' THEN CASE WHEN CASE WHEN da THEN pa <= pb ELSE pb <= pa END THEN CASE WHEN flat THEN 'left_boundary' ELSE 'bottom_boundary' END ELSE CASE WHEN flat THEN 'right_boundary' ELSE 'top_boundary' END END END AS reference,
          CASE WHEN type = 'between_circles' THEN CASE WHEN la < lb OR la = lb AND pa <= pb THEN ca ELSE cb END END AS left_circle, CASE WHEN type = 'between_circles' THEN CASE WHEN la < lb OR la = lb AND pa <= pb THEN cb ELSE ca END END AS right_circle FROM p""",
    "distance_edges": """SELECT CAST(l_orderkey AS VARCHAR) AS src, 'distance' AS rel, CAST(l_partkey AS VARCHAR) AS dst, l_quantity AS value FROM lineitem""",
    "redundant": """SELECT l_orderkey, l_linenumber, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "measurement_conflicts": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, abs(l_discount) AS actual FROM lineitem WHERE abs(l_discount) > abs(l_tax) AND abs(l_tax - abs(l_discount)) > 0.015""",
    "beside": """
        WITH j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, b.p_retailprice - a.p_retailprice AS dx, CAST(b.p_size - a.p_size AS DOUBLE) AS dy FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 1.5 AND abs(a.p_size - b.p_size) <= 1.5)
        SELECT a, b, CASE WHEN dx = 0 AND dy = 0 THEN 'same' WHEN dx > abs(dy) THEN 'right' WHEN -dx > abs(dy) THEN 'left' WHEN dy > 0 THEN 'above' ELSE 'below' END AS side FROM j WHERE sqrt(dx * dx + dy * dy) <= 1.5""",
    "datum_translate": """
        SELECT n_nationkey, CAST(n_nationkey * 10 + n_regionkey * 300 - min(n_nationkey) OVER (PARTITION BY n_regionkey) * 10 AS DOUBLE) AS x FROM nation""",
    "open_hops": """
        WITH RECURSIVE l AS (SELECT * FROM (SELECT n_nationkey AS src, unnest([(n_nationkey * 2 + 1) % 25, (n_nationkey + 7) % 25]) AS dst FROM nation) WHERE dst % 4 <> 0),
        w AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS hops FROM nation UNION SELECT w.start, l.dst, w.hops + 1 FROM w JOIN l ON l.src = w.node WHERE w.hops < 12)
        SELECT start, node, min(hops) AS hops FROM w GROUP BY start, node""",
    "solved_offsets": """
        WITH RECURSIVE w AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS x, 0 AS hops
          UNION ALL SELECT c_custkey, w.x + c_acctbal, w.hops + 1 FROM w JOIN customer ON c_custkey // 8 = w.node AND c_custkey <> 0)
        SELECT node, round(x, 4) AS x, hops FROM w""",
    "offset_conflicts": """
        WITH c AS (SELECT c_custkey, c_acctbal + c_nationkey % 2 AS value, CASE WHEN c_custkey = 0 THEN 0 ELSE c_acctbal END AS actual FROM customer)
        SELECT c_custkey // 8 AS src, c_custkey AS dst, round(value, 2) AS value, round(actual, 2) AS actual FROM c WHERE abs(value - actual) > 0.5""",
    "solved_grid": """
        SELECT n_name AS label, round(n_nationkey * CAST(61.7 AS DOUBLE), 6) AS raw, CASE WHEN n_nationkey < 10 THEN CAST((SELECT coalesce(sum(300 + m.n_nationkey % 3 * 50), 0) FROM nation m WHERE m.n_nationkey < n.n_nationkey) AS DOUBLE) END AS solved FROM nation n""",
    "aligned_sources": """
        WITH u AS (SELECT 's' AS src, s_suppkey AS k, s_acctbal AS x, s_nationkey * CAST(40 AS DOUBLE) AS y FROM supplier UNION ALL SELECT 'c', c_custkey, c_acctbal, c_nationkey * CAST(40 AS DOUBLE) FROM customer)
        SELECT CAST(floor(x / 200) AS BIGINT) AS cx, CAST(floor(y / 200) AS BIGINT) AS cy, CAST(count(DISTINCT src) AS INT) AS sources, count(*) AS n, min(k) FILTER (src = 's') AS drawing, min(k) FILTER (src = 'c') AS text FROM u GROUP BY 1, 2""",
    "contour_surface": """
        WITH q AS (SELECT p_retailprice AS px, p_size * CAST(10 AS DOUBLE) AS py, p_size * CAST(1.5 AS DOUBLE) + 500 AS e FROM part UNION ALL SELECT p_retailprice + 5, p_size * CAST(10 AS DOUBLE), p_size * CAST(1.5 AS DOUBLE) + 500 FROM part),
        t AS (SELECT i % 20 * CAST(50 AS DOUBLE) + 900 AS x, i // 20 * CAST(25 AS DOUBLE) AS y FROM range(400) r(i)),
        m AS (SELECT x, y, e, sqrt((x - px) ** 2 + (y - py) ** 2) AS d FROM t JOIN q ON abs(x - px) <= 40 AND abs(y - py) <= 40),
        g AS (SELECT x, y, count(*) AS n, avg(e) FILTER (d = 0) AS onto, sum(e / (d * d)) FILTER (d > 0) / sum(1 / (d * d)) FILTER (d > 0) AS w FROM m WHERE d <= 40 GROUP BY x, y)
        SELECT t.x, t.y, round(coalesce(onto, w), 5) AS elevation, coalesce(n, 0) AS n FROM t LEFT JOIN g USING (x, y)""",
    "fitted_line": """
        SELECT 'intercept' AS name, round(regr_intercept(p_retailprice / 1000, p_size), 6) AS value FROM part UNION ALL SELECT 'slope', round(regr_slope(p_retailprice / 1000, p_size), 6) FROM part""",
    "hole_coordinates": """
        SELECT c_custkey AS hole, round(CASE WHEN c_custkey % 5 <> 4 THEN c_acctbal ELSE c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0.25 END END, 2) AS x, CAST(c_nationkey AS DOUBLE) AS y,
          CAST(c_nationkey * 2 + CASE WHEN c_custkey % 7 <> 6 THEN 0 ELSE c_custkey % 2 END AS DOUBLE) AS z FROM customer
        WHERE (c_custkey % 5 <> 4 OR c_custkey % 7 <> 6) AND (c_custkey % 5 <> 4 OR c_custkey % 4 <> 3) AND (c_custkey % 7 <> 6 OR c_custkey % 4 <> 3)""",
    "reconciled_views": """
        WITH c AS (SELECT c_custkey AS hole, c_custkey % 5 <> 4 AS t, c_custkey % 7 <> 6 AS f, c_custkey % 4 <> 3 AS l, CASE WHEN c_custkey % 3 = 0 THEN CAST(2 AS DOUBLE) ELSE 0.25 END AS dx, CAST(c_custkey % 2 AS DOUBLE) AS dz FROM customer),
        g AS (SELECT *, CASE WHEN t AND f THEN dx WHEN t OR f THEN 0 END AS x_gap, CASE WHEN t OR l THEN 0 END AS y_gap, CASE WHEN f AND l THEN dz WHEN f OR l THEN 0 END AS z_gap FROM c)
        SELECT hole, CAST(t AS BIGINT) + CAST(f AS BIGINT) + CAST(l AS BIGINT) AS views, coalesce(x_gap <= 1 AND y_gap <= 1 AND z_gap <= 1, false) AS consistent, round(x_gap, 2) AS x_gap, z_gap FROM g WHERE t OR f OR l""",
    "near_pairs": """
        WITH j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, sqrt((a.p_retailprice - b.p_retailprice) ** 2 + CAST(a.p_size - b.p_size AS DOUBLE) ** 2) AS d FROM part a JOIN part b ON a.p_partkey < b.p_partkey
          AND abs(a.p_retailprice - b.p_retailprice) <= 2 AND abs(a.p_size - b.p_size) <= 2)
        SELECT a, b, round(d, 6) AS distance FROM j WHERE d <= 2""",
    "conflicts": """
        SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS greatest FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1""",
    "triples": """
        SELECT CAST(n_nationkey AS VARCHAR) AS s, 'name' AS p, n_name AS o FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR) FROM nation
        UNION ALL SELECT s_name, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier""",
    "node_lookup": """
        SELECT CAST(s_suppkey AS VARCHAR) AS id, 'supplier' AS label, s_name AS name FROM supplier WHERE s_nationkey = 3""",
    "label_parse": """SELECT p_partkey, round(p_retailprice, 2) AS surface, CAST(p_size AS DOUBLE) AS thickness, true AS floor_close FROM part""",
    "projection_error": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
        SELECT vec_id, round(sqrt((v[1] + 0.5::DOUBLE * v[2] - v[4]) ** 2 + (v[2] - 0.25::DOUBLE * v[3] - v[5]) ** 2), 9) AS error FROM e""",
    "bearing_step": """
        SELECT p_partkey, round(p_retailprice * cos(radians(p_size)), 6) AS x, round(p_retailprice * sin(radians(p_size)), 6) AS y FROM part""",
    "vote": """
        WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
        SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1""",
    "obj_lines": """SELECT p_partkey, printf('v %.6f %.6f %.6f', p_retailprice, CAST(p_size AS DOUBLE), CAST(0 AS DOUBLE)) AS line FROM part""",
}
