"""Operators on hand-written cases and against plain models."""

import math
import random
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions.labels import borehole
from plumbline.operators import clustering, constraints, graph, proximity, similarity
from plumbline.plans import flows, queries
from plumbline.sources import drawing
from plumbline.streaming import snapping


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("dx", "dy", "expected"), [(5, 5, "vertical"), (300, 0, "horizontal"), (0, 0, "vertical"), (None, 1, None)])
def test_orientation(spark, dx, dy, expected):
    assert one(spark, g.orientation(F.lit(dx).cast("double"), F.lit(dy).cast("double"))) == expected


def test_chebyshev_is_not_euclidean_and_needs_both(spark):
    assert one(spark, g.chebyshev(F.lit(3.0), F.lit(-4.0))) == 4.0
    assert one(spark, g.chebyshev(F.lit(3.0), F.lit(None).cast("double"))) is None


@pytest.mark.parametrize(("x", "solved", "expected"), [(302.0, [0, 300], 300), (302.5, [0, 300], 302.5), (1.0, [0, 2], 0), (925.6371636171406, [0.0, 300.0], 925.6371636171406), (5.0, [], 5.0), (None, [1], None)])
def test_snap_value(spark, x, solved, expected):
    assert one(spark, g.snap_value(F.lit(x).cast("double"), solved)) == expected


def test_snap_raw_takes_the_solved_value(spark):
    assert one(spark, g.snap_raw(F.lit(925.6), [(0.0, 0.0), (925.6371636171406, 300.0)])) == 300.0


def test_snap_point_keeps_other_coordinates(spark):
    assert one(spark, g.snap_point(F.array(*map(F.lit, (301.0, 1.0, 7.0))), [0, 300], [0, 300])) == [300.0, 0.0, 7.0]
    assert one(spark, g.snap_point(F.array(F.lit(1.0)), [0], [0])) == [1.0]


@pytest.mark.parametrize(("p", "infinite", "expected"), [((0, 1), False, 1.0), ((-3, 4), False, 5.0), ((-3, 4), True, 4.0)])
def test_line_distance(spark, p, infinite, expected):
    assert one(spark, g.line_distance(*[F.lit(float(v)) for v in (*p, 0, 0, 10, 0)], infinite=infinite)) == expected


def test_point_of_no_length_is_a_point(spark):
    assert one(spark, g.line_distance(*[F.lit(float(v)) for v in (3, 4, 0, 0, 0, 0)])) == 5.0


@pytest.mark.parametrize(("label", "expected"), [("1081.38 / 517.53 ° 4.83", (1081.38, 517.53, 4.83)), ("935.06 ° 6.39 / 461.89", (935.06, 461.89, 6.39)), ("none", (None, None, None))])
def test_borehole_labels_in_both_orders(spark, label, expected):
    assert tuple(one(spark, borehole(F.lit(label)))) == expected


def model_leaders(values, tol):
    groups, anchor = [], None
    for v in sorted(values):
        if anchor is None or v - anchor >= tol:
            anchor = v
            groups.append([])
        groups[-1].append(v)
    return groups


def test_leader_clusters_match_a_plain_fold(spark):
    rng = random.Random(1)
    lists = {0: [0, 15, 30, 45], 1: [0, 20], **{k: [rng.randint(0, 200) for _ in range(rng.randint(1, 40))] for k in range(2, 60)}}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in lists.items() for i, v in enumerate(vs)], "k int, o int, v double")
    got = {}
    for r in clustering.leader_clusters(df, ["k"], "v", "o").orderBy("k", "v").collect():
        got.setdefault(r["k"], {}).setdefault(r["group_no"], []).append(r["v"])
    assert {k: [x[n] for n in sorted(x)] for k, x in got.items()} == {k: model_leaders(vs, 20) for k, vs in lists.items()}


def test_leader_clusters_as_given_depend_on_order(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([15, 0, 30])], "k int, o int, v double")
    assert {r["group_no"] for r in clustering.leader_clusters_as_given(df, ["k"], "v", "o").collect()} == {1}


def model_rows(rows, max_rows):
    out, run = [], []
    for r in sorted(set(rows)):
        if run and (r != run[-1] + 1 or len(run) == max_rows):
            out.append(run)
            run = []
        run.append(r)
    return [*out, run] if run else out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 15), min_size=1, max_size=20), st.integers(1, 4))
def test_row_bounded_groups_match_a_walk(spark, rows, max_rows):
    df = spark.createDataFrame([(1, r) for r in rows], "v int, r int")
    got = {}
    for r in clustering.row_bounded_groups(df, "v", "r", max_rows).collect():
        got.setdefault((r["island"], r["chunk"]), set()).add(r["r"])
    assert sorted(sorted(x) for x in got.values()) == model_rows(rows, max_rows)


def test_row_bounded_groups_refuse_none(spark):
    with pytest.raises(ValueError):
        clustering.row_bounded_groups(spark.range(1), "id", "id", 0)


def test_circles_without_a_row_raise(spark):
    with pytest.raises(KeyError):
        clustering.require_rows(spark.range(3), spark.range(2), "id")


def test_gaps_and_columns(spark):
    p = spark.createDataFrame([(1, 2400.0, 1200.0), (2, 2401.0, 1700.0), (3, 2399.0, 2100.0), (4, 10.0, 1300.0)], "c int, x double, y double")
    assert {(r["a"], r["b"]) for r in clustering.column_links(p, "c", "x", "y", 3.0, 600.0).collect()} == {(1, 2), (2, 3)}
    wide = clustering.gaps(p.withColumn("k", F.lit(1)), ["k"], "y", "c", 350.0)
    assert {r["c"]: r["wide"] for r in wide.collect()} == {1: False, 4: False, 2: True, 3: True}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-60, 60), max_size=25), st.lists(st.integers(-60, 60), max_size=25), st.booleans())
def test_band_join_is_the_theta_join(spark, left, right, inclusive):
    a = spark.createDataFrame([(i, v / 2) for i, v in enumerate(left)], "i int, x double")
    b = spark.createDataFrame([(j, v / 2) for j, v in enumerate(right)], "j int, y double")
    got = sorted((r["i"], r["j"]) for r in proximity.band_join(a, b, "x", "y", 5.0, inclusive=inclusive).collect())
    assert got == sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if abs(x - y) / 2 < 5 or inclusive and abs(x - y) / 2 == 5)


def test_nearest_ties_go_to_the_lower_ordinal_and_none_is_null(spark):
    left = spark.createDataFrame([(1, 0.0), (2, 1000.0)], "k int, y double")
    right = spark.createDataFrame([(7, 1, -5.0), (8, 0, 5.0), (9, 2, 30.0)], "c int, o int, cy double")
    assert {r["k"]: r["c"] for r in proximity.nearest(left, right, "k", "y", "cy", "o", 30.0, ["c"]).collect()} == {1: 8, 2: None}
    right = spark.createDataFrame([(7, 0, 15.0), (8, 1, 1.0)], "c int, o int, cy double")
    assert {r["k"]: r["c"] for r in proximity.first_match(left, right, "k", "y", "cy", "o", 20.0, ["c"]).collect()} == {1: 7, 2: None}


def test_beside_names_the_side(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 1.0), (3, 0.0, -2.0)], "c int, x double, y double")
    assert {(r["a"], r["b"]): r["side"] for r in proximity.beside(p, "c", "x", "y", 3.2).collect()} == {(1, 2): "right", (1, 3): "below"}


def test_datum_assign_in_both_modes(spark):
    c = spark.createDataFrame([(1, 10.0, 0), (2, 50.0, 0), (3, 7.0, 1)], "c int, x double, r int")
    d = spark.createDataFrame([(0, 300.0)], "r int, value double")
    assert {r["c"]: r["x"] for r in constraints.datum_assign(c, d, "r", "x", "value").collect()} == {1: 300.0, 2: 300.0, 3: 7.0}
    d = spark.createDataFrame([(0, 300.0, 1)], "r int, value double, ref int")
    assert {r["c"]: r["x"] for r in constraints.datum_assign(c, d, "r", "x", "value", "translate", "ref", "c").collect()} == {1: 300.0, 2: 340.0, 3: 7.0}


def test_ordered_shift_reads_earlier_results(spark):
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate([10.0, 405.0, 912.0])] + [(2, 0, 5.0)], "r int, o int, x double")
    rel = spark.createDataFrame([(1, 1, 0, 1, 400.0), (1, 2, 1, 2, 500.0)], "r int, seq int, left_ordinal int, right_ordinal int, value double")
    assert {(r["r"], r["o"]): r["x"] for r in constraints.ordered_shift(p, rel, "r", "o", "x").collect()} == {(1, 0): 10.0, (1, 1): 410.0, (1, 2): 910.0, (2, 0): 5.0}


def test_ordered_shift_query_reads_all_orders(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice([5, 199, 200, 731, 90_000]), round(rng.uniform(1, 500_000), 2)) for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    expected = []
    for c in {c for _, c, _ in rows}:
        xs = [x for x, _ in sorted((x, o) for o, k, x in rows if k == c)]
        for n in range(2, len(xs) + 1):
            left, shift = xs[n - 2], xs[n - 2] + 100 + n - xs[n - 1]
            xs = [x + shift if x > left else x for x in xs]
        expected += [(c, i + 1, round(x, 2)) for i, x in enumerate(xs)]
    got = [tuple(r) for r in queries.ordered_shift(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(c, n, pytest.approx(x, abs=0.011)) for c, n, x in sorted(expected)]


def test_conflicts_and_redundant(spark):
    e = flows.distance_graph(spark.createDataFrame([("Row_3", "Row_4", 500.0), ("Row_3", "Row_4", 400.0), ("a", "b", 1.0), ("a", "b", 1.0)], "from string, to string, value double"))
    assert [(r["src"], r["dst"]) for r in e[1].collect()] == [("Row_3", "Row_4")]
    assert [r["src"] for r in constraints.redundant(e[0], ["src", "dst"], "value").collect()] == ["a"]
    m = spark.createDataFrame([(3.0, 4.0, 4.0), (3.0, 4.0, 5.0)], "dx double, dy double, measurement double")
    assert constraints.measurement_conflicts(m, "dx", "dy", "measurement", 0.5).count() == 1


def test_relations_of_a_view(spark):
    circles = spark.createDataFrame([(21, 0.0, 0.0, 0), (8, 400.0, 10.0, 1), (24, 300.0, 200.0, 2)], "circle_id int, x double, y double, ordinal int")
    dims = spark.createDataFrame([("402", 400.0, 11.0, 0.0, 1.0, 400.0), ("3F5", 0.0, 600.0, 300.0, 205.0, 300.0), ("v", 0.0, 0.0, 0.0, 50.0, 50.0)], "handle string, x2 double, y2 double, x3 double, y3 double, value double")
    dims = dims.withColumn("y2", F.when(F.col("handle") == "3F5", 400.0).otherwise(F.col("y2")))
    got = {r["handle"]: r for r in constraints.resolve_dimensions(dims, circles, line_x=spark.createDataFrame([(0.0,)], "x double")).collect()}
    assert set(got) == {"402", "3F5", "v"}
    assert (got["402"]["axis"], got["402"]["type"], got["402"]["left_circle"], got["402"]["right_circle"]) == ("x", "between_circles", 21, 8)
    assert (got["v"]["axis"], got["v"]["type"], got["v"]["row_ref_circle"], got["v"]["reference"]) == ("y", "datum", 21, "top_boundary")
    assert (got["3F5"]["type"], got["3F5"]["row_ref_circle"], got["3F5"]["reference"]) == ("datum", 24, "left_boundary")
    _, rows = flows.relations(dims, circles)
    assert {r["circle_id"]: r["group_no"] for r in rows.collect()} == {21: 1, 8: 1, 24: 2}


def test_graph(spark):
    t = graph.triples(spark.createDataFrame([("2033", "935.06", None)], "hole string, surface string, other string"), "hole", {"surface": "surface", "other": "other"})
    n = graph.nodes(t, "borehole")
    assert [r["id"] for r in graph.lookup(n, "borehole", surface="935.06").collect()] == ["2033"] and graph.lookup(n, "borehole", surface="1").count() == 0
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    got = {r["node"]: r["hops"] for r in graph.reachable(links, spark.createDataFrame([(1,)], "start int"), 5).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


def test_similarity(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0])], "i int, e array<double>")
    assert [(r["id"], r["rank"]) for r in similarity.cosine_topk(v, v.filter("i = 1"), "i", "e", 2).orderBy("rank").collect()] == [(2, 1), (3, 2)]
    with pytest.raises(ValueError):
        similarity.cosine_topk(v, v, "i", "e", 2, max_queries=2)
    assert similarity.vote(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, c string"), "k", "c").orderBy("k").collect()[0]["c"] == "a"


def test_cosine_topk_takes_any_number_of_queries(spark):
    rng = random.Random(6)
    v = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)], "i int, e array<double>")
    whole, parts = (sorted(map(tuple, similarity.cosine_topk(v, v, "i", "e", 3, block=b).collect())) for b in (40, 7))
    assert len(whole) == 120 and parts == whole
    many = spark.range(10_001).select(F.col("id").cast("int").alias("i"), F.array(F.lit(1.0), F.col("id") % 7 + 0.5).alias("e"))
    got = similarity.cosine_topk(many.filter("i < 2"), many, "i", "e", 1)
    assert got.count() == got.select("query").distinct().count() == 10_001


def test_projection(spark):
    seen, p = F.array(F.lit(1.0), F.lit(2.0)), F.array(*map(F.lit, (1.0, 2.0, 3.0)))
    assert one(spark, g.projection_error(seen, p, [[1, 0, 0], [0, 1, 1]])) == 3.0
    x, y = one(spark, g.bearing_step(F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(100.0)))
    assert math.isclose(x, 100 * math.cos(math.pi / 6)) and math.isclose(y, 50.0)
    assert math.isclose(one(spark, g.cosine(seen, seen)), 1.0) and one(spark, g.cosine(seen, F.array(F.lit(0.0), F.lit(0.0)))) is None


ENTITIES = """[
 {"type": "LINE", "attributes": {"start": [301, 1, 7], "end": [5], "radius": 3}},
 {"type": "DIMENSION", "attributes": {"defpoint2": [1, 0], "defpoint3": [299, 2], "measurement": 12}},
 {"type": "DIMENSION", "attributes": {"defpoint2": [1, 0], "measurement": 12}},
 {"type": "INSERT", "attributes": {"insert_point": [1, 1], "attributes": [{"insert": [299, 301]}]}},
 {"type": "LWPOLYLINE", "attributes": {"vertices": [[1, 1], [299, 50]]}}
]"""


def test_drawings_from_json_to_snapped_entities(spark, tmp_path):
    (tmp_path / "top.json").write_text(ENTITIES)
    got = flows.snap_drawings(spark, str(tmp_path / "top.json"), [0, 300], [0, 300])
    rows = {r["ordinal"]: r for r in got.collect()}
    assert [rows[i]["type"] for i in range(5)] == ["LINE", "DIMENSION", "DIMENSION", "INSERT", "LWPOLYLINE"]
    assert rows[0]["start"] == [300.0, 0.0, 7.0] and rows[0]["end"] == [5.0]
    assert rows[1]["measurement"] == 300.0 and rows[2]["measurement"] == 12.0
    assert rows[3]["insert_point"] == [0.0, 0.0] and rows[3]["inserts"][0]["insert"] == [300.0, 300.0]
    assert rows[4]["vertices"] == [[0.0, 0.0], [300.0, 50.0]]
    drawing.write_json_lines(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).filter("type = 'LINE'").first()["attributes"]["start"] == [300.0, 0.0, 7.0]


def test_obj_has_vertices_then_faces(spark, tmp_path):
    v = spark.createDataFrame([(2, 12.4, 5.7, 3.3), (1, 12.34, 5.67, 3.21)], "idx int, x double, y double, z double")
    drawing.write_obj(v, spark.createDataFrame([(1, 2, 1)], "i int, j int, k int"), str(tmp_path / "mesh"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "mesh").glob("part-*")))
    assert text.splitlines() == ["v 12.340000 5.670000 3.210000", "v 12.400000 5.700000 3.300000", "f 1 2 1"]


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:10:00", "a", 2.0), ("2024-01-01 00:20:00", "b", 1.0), ("2024-01-02 00:00:00", "z", 1.0)]
    df = spark.createDataFrame(rows, "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    for name, f in (("snapped", lambda s: snapping.snap_stream(s, "v", [0.5], 1.0)), ("conflict", lambda s: snapping.conflict_stream(s, ["k"], "v", "t"))):
        q = f(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert {r["v"] for r in spark.table("snapped").collect()} == {0.5, 2.0}
    assert [r["k"] for r in spark.table("conflict").collect()] == ["a"]


LOSSLESS = """[
 {"type": "CIRCLE", "handle": "1F", "layer": "L1", "color": 7, "attributes": {"center": [301, 1, 7], "radius": 3, "text": "393", "unknown": {"a": [1, null]}}},
 {"type": "INSERT", "handle": "2A", "attributes": {"insert_point": [1, 1], "attributes": [{"insert": [299, 301], "tag": "T", "h": 2.5}, {"tag": "no point"}]}},
 {"type": "TEXT", "attributes": {"attributes": [{"insert": [299, 301]}], "start": "none", "end": [5]}},
 {"type": "DIMENSION", "attributes": {"defpoint2": [1, 0], "defpoint3": [299, 2], "dimtype": 32}},
 {"type": "NOTHING", "k": "ü"}, 5
]"""


def test_what_is_no_point_survives_the_round_trip(spark, tmp_path):
    import json

    for name in ("top", "left"):
        (tmp_path / f"{name}.json").write_text(LOSSLESS)
    entities = drawing.read_entities(spark, str(tmp_path / "*.json"))
    assert drawing.write_json_arrays(drawing.transform(entities, [0, 300], [0, 300]), str(tmp_path / "out")) == 12
    expected = json.loads(LOSSLESS)
    expected[0]["attributes"]["center"] = [300, 0, 7]
    expected[1]["attributes"] |= {"insert_point": [0, 0]}
    expected[1]["attributes"]["attributes"][0]["insert"] = [300, 300]
    expected[3]["attributes"] |= {"defpoint2": [0, 0], "defpoint3": [300, 0], "measurement": 300}
    for name in ("top", "left"):
        (part,) = (tmp_path / "out" / f"file={name}.json").glob("part-*")
        assert json.loads(part.read_text()) == expected
    raw = drawing.transform(entities, [(301.0, 950.0)], [], snap=g.snap_raw)
    assert drawing.typed(raw).filter("handle = '1F'").first()["center"] == [950.0, 1.0, 7.0]


def test_snap_dimensions_to_rows_and_boundary(spark):
    dims = spark.createDataFrame([("overall", 0.5, 4200.0), ("inner", 1000.0, 2000.0), ("free", 500.0, None)], "d string, a double, b double")
    rows = spark.createDataFrame([("Row_1", 1001.0, 1), ("Row_2", 1999.0, 2), ("edge row", 4201.0, 3)], "l string, y double, o int")
    edges = spark.createDataFrame([("BOUNDARY_0", 0.0, 1), ("BOUNDARY_4200", 4199.0, 2)], "l string, y double, o int")
    got = {r["d"]: (r["row_a"], r["row_b"]) for r in proximity.snap_dimensions(dims, ("a", "b"), rows, "l", "y", "o", 5.0, edges).collect()}
    assert got == {"overall": ("BOUNDARY_0", "edge row"), "inner": ("Row_1", "Row_2"), "free": (None, None)}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-40, 40)), max_size=20), st.lists(st.tuples(st.integers(0, 1), st.integers(-40, 40)), max_size=20))
def test_nearest_is_the_least_of_all_pairs(spark, left, right):
    a = spark.createDataFrame([(i, g_, v / 2) for i, (g_, v) in enumerate(left)], "i int, g int, x double")
    b = spark.createDataFrame([(j, g_, v / 2) for j, (g_, v) in enumerate(right)], "j int, g int, y double")
    got = {r["i"]: r["j"] for r in proximity.nearest(a, b, "i", "x", "y", "j", 4.0, ["j"], ("g",)).collect()}
    assert got == {i: min(((abs(x - y), j) for j, (k, y) in enumerate(right) if k == g_ and abs(x - y) < 8), default=(0, None))[1] for i, (g_, x) in enumerate(left)}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-60, 60), max_size=15), st.lists(st.integers(-60, 60), max_size=25))
def test_first_match_is_the_first_of_all_pairs(spark, left, right):
    a = spark.createDataFrame([(i, v / 10) for i, v in enumerate(left)], "i int, x double")
    b = spark.createDataFrame([(j, v / 10) for j, v in enumerate(right)], "j int, y double")
    got = {r["i"]: r["j"] for r in proximity.first_match(a, b, "i", "x", "y", "j", 1.1, ["j"]).collect()}
    assert got == {i: min((j for j, y in enumerate(right) if abs(x / 10 - y / 10) < 1.1), default=None) for i, x in enumerate(left)}


def test_line_reference_takes_the_first_line_and_skips_points_near_circles(spark):
    points = spark.createDataFrame([(1, 5.0, 4.0), (2, 50.0, 19.0), (3, 200.0, 0.0), (4, -14.9, 0.0)], "k int, x double, y double")
    lines = spark.createDataFrame([("far", 0, 0.0, 15.0, 100.0, 15.0), ("near", 1, 0.0, 0.0, 100.0, 0.0)], "l string, o int, x1 double, y1 double, x2 double, y2 double")
    found = lambda c: {r["k"]: r["l"] for r in proximity.line_reference(points, "k", "x", "y", lines, "l", "o", 15.0, c).collect()}
    assert found(None) == {1: "far", 2: "far", 4: "near"}
    assert found(spark.createDataFrame([(5.0, 10.0)], "x double, y double")) == {2: "far"}


def test_offsets_of_a_tree_with_a_conflict(spark):
    e = spark.createDataFrame([("a", "b", 300.0), ("c", "b", 100.0), ("c", "d", 50.0), ("a", "d", 260.0), ("y", "z", 1.0)], "src string, dst string, value double")
    x = constraints.solve_offsets(e, spark.createDataFrame([("a", 10.0)], "node string, x double"))
    assert {r["node"]: (r["x"], r["hops"]) for r in x.collect()} == {"a": (10.0, 0), "b": (310.0, 1), "d": (270.0, 1), "c": (210.0, 2)}
    assert [(r["src"], r["dst"], r["actual"]) for r in constraints.offset_conflicts(e, x).collect()] == [("c", "d", 60.0)]
    grid = constraints.solve_grid(spark.createDataFrame([("0", 0.0), ("B", 925.637), ("q", 5.0)], "label string, raw double"), spark.createDataFrame([("0", "B", 300.0)], "src string, dst string, value double"))
    assert {r["label"]: r["solved"] for r in grid.collect()} == {"0": 0.0, "B": 300.0, "q": None}


def test_views_of_a_hole(spark):
    views = {"top": spark.createDataFrame([(1, 12.34, 5.67), (2, 12.4, 5.7), (3, 1.0, 1.0)], "h int, x double, y double"), "front": spark.createDataFrame([(1, 12.34, 3.21), (2, 13.0, 3.3)], "h int, x double, z double")}
    assert {r["h"]: (r["x"], r["y"], r["z"]) for r in constraints.hole_coordinates(views, "h", 0.1).collect()} == {1: (12.34, 5.67, 3.21), 2: (12.4, 5.7, 3.3)}
    assert {r["h"]: (r["views"], r["consistent"]) for r in constraints.reconcile_views(views, "h", 0.1).collect()} == {1: (2, True), 2: (2, False), 3: (1, False)}


def test_minimise_fits_a_curve(spark):
    df = spark.range(1, 60).select((F.col("id") / 10).alias("t")).withColumn("y", 3.0 * F.exp(-0.7 * F.col("t")) + 0.5)
    got = constraints.minimise(df, lambda p: [p[0] * F.exp(-F.lit(p[1]) * F.col("t")) + p[2] - F.col("y")], [1.0, 1.0, 0.0])
    assert all(math.isclose(a, b, abs_tol=1e-5) for a, b in zip(got, (3.0, 0.7, 0.5), strict=True))


def test_surface_and_alignment(spark):
    p = spark.createDataFrame([(0.0, 0.0, 520.0), (10.0, 0.0, 540.0), (10.0, 0.0, 550.0)], "x double, y double, elevation double")
    t = spark.createDataFrame([(5.0, 0.0), (10.0, 0.0), (99.0, 99.0)], "x double, y double")
    assert {r["x"]: (r["elevation"], r["n"]) for r in proximity.surface(p, t, 6.0).collect()} == {5.0: (pytest.approx(1610 / 3), 3), 10.0: (545.0, 2), 99.0: (None, 0)}
    rows = proximity.align_sources({"a": p.withColumn("k", F.lit(1)), "b": t.withColumn("k", F.lit(2))}, "k", "x", "y", 20.0).collect()
    assert {(r["cx"], r["cy"]): (r["sources"], r["n"], r["a"], r["b"]) for r in rows} == {(0, 0): (2, 5, 1, 2), (4, 4): (1, 1, None, 2)}


def test_plans_of_hops_do_not_grow(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    got = graph.reachable(links, spark.createDataFrame([(0,)], "start int"), 10)
    assert got.count() == 11 and len(got._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 40


def test_columns_read_literally_break_at_a_third_x(spark):
    p = spark.createDataFrame([(1, 2400.0, 1200.0), (2, 2401.0, 1700.0), (3, 2399.0, 2100.0)], "c int, x double, y double")
    assert {(r["a"], r["b"]) for r in clustering.column_links(p, "c", "x", "y", 3.0, 1000.0, between="x").collect()} == {(1, 2), (1, 3)}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=30), st.lists(st.one_of(st.none(), st.integers(-50, 50).map(lambda v: v / 2), st.sampled_from([float("nan"), float("inf"), -1e300])), max_size=20))
def test_snapping_by_bisection_is_the_nearest_of_all(spark, grid, values):
    def model(x, tol=2.0):
        if x is None or x != x:
            return x
        d, i = min((abs(x - v), i) for i, v in enumerate(grid))
        return grid[i] * 10.0 if d <= tol else x

    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    snapped = df.select("i", g.snap_raw(F.col("x"), [(v, v * 10) for v in grid]).alias("x"))
    assert [repr(r["x"]) for r in sorted(snapped.collect())] == [repr(model(x)) for x in values]
    assert "array_min" not in snapped._jdf.queryExecution().optimizedPlan().toString()
    close = spark.range(1).select(g.snap_raw(F.lit(1e5), [(0.0, 1.0), (5e-324, 2.0)], 1e6))
    assert close.first()[0] == 1.0


def test_entity_transform_uses_all_cores(spark):
    assert queries.entity_transform(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def crowd(spark, n=90, seed=5):
    """Points of which many share a place, one without a place and one without a key."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(12) / 2 - 2, rng.randrange(5) / 1.0) for i in range(n)] + [(n, None, 1.0), (n + 1, float("nan"), 1.0), (None, 0.0, 0.0)]
    return [r for r in rows if None not in r and r[1] == r[1]], spark.createDataFrame(rows, "c int, x double, y double")


def test_near_pairs_of_places_that_many_points_share(spark):
    rows, p = crowd(spark)
    got = proximity.near_pairs(p, "c", "x", "y", 1.5, digits=3)
    expected = sorted((a[0], b[0], round(math.hypot(a[1] - b[1], a[2] - b[2]), 3)) for a in rows for b in rows if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 1.5)
    assert sorted(map(tuple, got.collect())) == expected
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_beside_of_places_that_many_points_share(spark):
    rows, p = crowd(spark)

    def side(dx, dy):
        return "same" if dx == dy == 0 else ("right" if dx > 0 else "left") if abs(dy) < abs(dx) else "above" if dy > 0 else "below"

    got = proximity.beside(p, "c", "x", "y", 1.5)
    expected = sorted((a[0], b[0], side(b[1] - a[1], b[2] - a[2])) for a in rows for b in rows if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 1.5)
    assert sorted((r["a"], r["b"], r["side"]) for r in got.collect()) == expected
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 3, 64])
def test_pairs_of_keys_in_slices(spark, size):
    rows = [(list(range(70)), list(range(70)), True), ([1, 5, 9, 200], [2, 7, 300, 4, 8], False), ([3], [1], False)]
    pairs = spark.createDataFrame(rows, "_p array<int>, _q array<int>, same boolean")
    got = proximity.each_pair(pairs, F.lit(False), F.col("same"), ["same"], size).drop("_turned")
    expected = [(min(a, b), max(a, b), same) for p, q, same in rows for a in p for b in q if a < b or not same]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_beside_of_one_place_in_little_memory():
    """8,000 points of one place are 32 million pairs, which a session of 512 MB can't hold."""
    code = """
from pyspark.sql import functions as F
from plumbline.operators import proximity
from plumbline.session import local_session
spark = local_session(2, 2, "512m")
p = spark.range(8000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
proximity.beside(p, "id", "x", "y", 1.5).write.format("noop").mode("overwrite").save()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)


def above(a, b):
    """b lies above a: by y, then by key; a null key is above by y alone."""
    return b[2] > a[2] or b[2] == a[2] and None not in (a[0], b[0]) and b[0] > a[0]


@pytest.mark.parametrize(("seed", "x_tol", "y_tol"), [(1, 1.5, 4.0), (2, 0.5, 2.0), (3, 3.0, 1.0)])
def test_column_links_are_the_next_aligned_above(spark, seed, x_tol, y_tol):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(30) / 2 - 2, float(rng.randrange(12))) for i in range(120)] + [(None, 1.0, 3.0), (None, 1.0, 20.0), (121, 1.0, 19.0)]
    p = spark.createDataFrame([*rows, (130, None, 1.0), (131, float("nan"), 1.0)], "c int, x double, y double")
    expected = {}
    for a in rows:
        over = min(((b[2], b[0] if b[0] is not None else -1) for b in rows if abs(a[1] - b[1]) < x_tol and above(a, b)), default=None)
        if over and over[0] - a[2] < y_tol:
            expected[a[0], a[2]] = (None if over[1] == -1 else over[1], over[0] - a[2])
    got = clustering.column_links(p, "c", "x", "y", x_tol, y_tol)
    assert sorted(((r["a"], r["b"], r["gap"]) for r in got.collect()), key=repr) == sorted(((k[0], *v) for k, v in expected.items()), key=repr)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("seed", "x_tol", "y_tol"), [(1, 1.5, 4.0), (2, 0.5, 2.0), (3, 3.0, 1.0)])
def test_columns_read_literally_of_places_that_many_points_share(spark, seed, x_tol, y_tol):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0.0, 0.25, 1.0, 2.0, 7.0, 7.5]), float(rng.randrange(8))) for i in range(90)] + [(None, 1.0, 3.0)]
    p = spark.createDataFrame([*rows, (130, None, 1.0), (131, float("nan"), 1.0)], "c int, x double, y double")
    xs = {r[1] for r in rows}
    parted = lambda a, b: any(min(a[1], b[1]) < x < max(a[1], b[1]) for x in xs)
    expected = [(a[0], b[0], b[2] - a[2]) for a in rows for b in rows if above(a, b) and abs(a[1] - b[1]) < x_tol and b[2] - a[2] < y_tol and not parted(a, b)]
    got = clustering.column_links(p, "c", "x", "y", x_tol, y_tol, between="x")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    # Neither side of the join of places is broadcast for looking small.
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "_link" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_ordered_shift_moves_points_that_share_the_left_ones_x(spark):
    p = spark.createDataFrame([(1, 1, 10.0), (1, 2, 10.0), (1, 3, 10.0), (1, 4, None), (2, 1, 5.0), (None, 1, 7.0)], "r int, o int, x double")
    rel = spark.createDataFrame([(1, 1, 1, 2, 100.0), (1, 2, 2, 3, 50.0), (1, 3, 3, 4, 9.0), (1, 4, 3, 99, 9.0), (3, 1, 1, 2, 9.0), (None, 1, 1, 1, 9.0)], "r int, seq int, left_ordinal int, right_ordinal int, value double")
    got = {(r["r"], r["o"]): r["x"] for r in constraints.ordered_shift(p, rel, "r", "o", "x").collect()}
    assert got == {(1, 1): 10.0, (1, 2): 110.0, (1, 3): 160.0, (1, 4): None, (2, 1): 5.0, (None, 1): 7.0}
