"""Pairs of shapes, readers, states and reports against brute force, round trips and small fixtures."""

import random
import struct
import time
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from cadastra.functions import kernel, pairs_of_shapes as pos
from cadastra.operators import areas, evaluation, features, hypotheses, pipelines, proximity, reports, states, trust
from cadastra.sources import readers, sinks


def star(rng, cx=0.0, cy=0.0, n=12, r=1.0):
    t = np.sort([rng.random() * 2 * np.pi for _ in range(n)])
    p = np.array([[cx + np.cos(a) * r * (0.4 + 0.6 * rng.random()), cy + np.sin(a) * r * (0.4 + 0.6 * rng.random())] for a in t])
    p = np.array(sorted(p.tolist(), key=lambda q: np.arctan2(q[1] - cy, q[0] - cx)))
    return np.vstack((p, p[:1]))


def test_difference_and_overlap_add_up():
    rng = random.Random(4)
    for _ in range(20):
        a, b = star(rng), star(rng, 0.7, 0.2)
        if not (kernel.is_valid(a) and kernel.is_valid(b)):
            continue
        rest = sum(abs(kernel.area(p)) for p in pos.difference(a, b))
        assert abs(rest + kernel.overlap_area(a, b) - abs(kernel.area(a))) < 1e-6


def test_distance_against_samples():
    rng = random.Random(6)
    for _ in range(10):
        a, b = star(rng), star(rng, 4.0, 1.0)
        dense = lambda r: np.vstack([p + np.linspace(0, 1, 200)[:, None] * d for p, d in zip(r[:-1], np.diff(r, axis=0), strict=True)])
        p, q = dense(a), dense(b)
        brute = np.sqrt(((p[:, None] - q) ** 2).sum(2)).min()
        assert abs(pos.distance(a, b) - brute) < 0.01
    assert pos.distance(star(rng), star(rng)) == 0


def test_shared_length_and_lines():
    a, b = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [0, 0.0]]), np.array([[2, 1], [4, 1], [4, 5], [2, 5], [2, 1.0]])
    assert pos.shared_length(a, b) == 1 and pos.shared_length(a, b + 1) == 0
    u = np.array([[0, 0], [3, 0], [3, 3], [2, 3], [2, 1], [1, 1], [1, 3], [0, 3], [0, 0.0]])
    assert abs(pos.length_inside(np.array([[-1, 2], [4, 2.0]]), u) - 2) < 1e-9 and pos.length_inside(np.array([[9, 9], [9, 10.0]]), u) == 0


def test_faces_of_a_grid_with_dangling_ends():
    lines = [np.array([[-1, k], [3, k]], float) for k in range(3)] + [np.array([[k, -1], [k, 3]], float) for k in range(3)] + [np.array([[0.5, 0.5], [0.7, 0.7]])]
    assert sorted(round(kernel.area(f), 6) for f in pos.faces(lines)) == [1.0] * 4
    assert pos.faces([]) == [] and pos.faces([np.array([[0, 0], [1, 1.0]])]) == []


def test_odd_texts_give_nothing(spark):
    df = spark.createDataFrame([(None, None), ("", "x"), ("POLYGON ((0 0, 1", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ("LINESTRING (0 0)", "POINT (1 1)")], "a string, b string")
    r = df.select(pos.wkt_pair("a", "b").alias("p"), pos.wkt_difference("a", "b").alias("d"), pos.wkt_area("a").alias("s"), pos.line_in_polygon("a", "b").alias("l"), pos.centre_line("a").alias("c"), kernel.wkt_profile("a").alias("k")).collect()
    assert all(x["p"]["inter"] is None and x["d"] is None and x["s"] == 0 and x["l"] == 0 and x["c"] is None and x["k"]["valid"] is None for x in r)


def shapefile(polygons):
    body, k = b"", 0
    for rings in polygons:
        pts = [p for r in rings for p in r]
        starts = np.cumsum([0] + [len(r) for r in rings])[:-1]
        rec = struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(rings), len(pts)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        k += 1
        body += struct.pack(">2i", k, len(rec) // 2) + rec
    body += struct.pack(">2i", k + 1, 2) + struct.pack("<i", 0)  # a null shape
    return b"\0" * 100 + body


def test_shapefile(spark, tmp_path):
    outer, hole, other = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], [(5, 5), (5, 6), (6, 6), (5, 5)]
    (tmp_path / "gis_osm_landuse_a_free_1.shp").write_bytes(shapefile([[outer, hole], [outer, other]]))
    head = struct.pack("<4BIHH", 3, 0, 0, 0, 3, 32 + 32 + 1, 1 + 8) + b"\0" * 20 + b"fclass".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8]) + b"\0" * 15 + b"\r"
    (tmp_path / "gis_osm_landuse_a_free_1.dbf").write_bytes(head + b" park    " + b" forest  " + b"         ")
    got = readers.read_shapefiles(spark, str(tmp_path)).collect()
    assert [(r["layer"], r["properties"]["fclass"]) for r in got] == [("gis_osm_landuse_a_free_1", k) for k in ("park", "forest", "")]
    assert got[0]["wkt"] == "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))" and got[1]["wkt"].startswith("MULTIPOLYGON (((0 0") and got[2]["wkt"] is None


def test_pair_features_against_difflib(spark):
    names = ["翠园小区一期", "翠园小区二期", "甲2号院", "2号院", "25号", "东里(北区)", None, "", "翠园小区"]
    rows = [(a, b, "x", "x" if i % 2 else None, 116.0, 39.0, 116.001, 39.0, 0.5, 1.0, 2.0, 0.4) for i, a in enumerate(names) for b in names]
    df = spark.createDataFrame(rows, "name_a string, name_b string, district_a string, district_b string, lng_a double, lat_a double, lng_b double, lat_b double, inter double, area_a double, area_b double, bge_sim double")
    got = features.pair_features(df).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b = r["name_a"] or "", r["name_b"] or ""
        assert abs(r["name_sim"] - (SequenceMatcher(None, a, b).ratio() if a and b else 0.0)) < 1e-9 and r["district_match"] and abs(r["iou"] - 0.2) < 1e-9
    by = {(r["name_a"], r["name_b"]): r for r in got}
    assert by["翠园小区一期", "翠园小区二期"]["phase_conflict"] and by["翠园小区一期", "翠园小区"]["is_hierarchical_phase"] and by["甲2号院", "2号院"]["court_conflict"] and by["25号", "2号院"]["cross_num_conflict"]


def test_k_nearest_against_brute_force(spark):
    rng = random.Random(8)
    left = [(i, rng.random() * 5, rng.random() * 5) for i in range(60)] + [(60, 90.0, -40.0)]
    right = [(i, rng.random() * rng.choice((0.2, 5)), rng.random() * 5, float(i)) for i in range(80)]
    a, b = spark.createDataFrame(left, "k bigint, x double, y double"), spark.createDataFrame(right, "other bigint, x double, y double, v double")
    got = {(r["k"], r["other"]) for r in hypotheses.k_nearest(a, b, "k", 0.05, 3).collect()}
    want = {(k, o) for k, x, y in left for _, o in sorted((np.hypot(x - p, y - q), o) for o, p, q, _ in right)[:3]}
    assert got == want
    assert hypotheses.nearest(a, b.limit(0), "k", 0.1).count() == 0 and hypotheses.k_nearest(a, b.limit(2), "k", 0.1, 5).count() == 122


def test_roster_reach(spark):
    roster = spark.createDataFrame([(1, "a b c", 116.0 + s, 40.0) for s in (0.0, 0.01, 0.02)], "roster_id bigint, name string, x double, y double")
    for km in (2.7, 2.9):
        polys = roster.select(F.lit(7).alias("poly_id"), "name", (F.col("x") + km / 111.32 / np.cos(np.radians(40))).alias("x"), "y")
        for k in (0.0, 0.01, 0.02):
            assert pipelines.roster_match(roster.where(F.abs(F.col("x") - 116 - k) < 1e-9), polys.where(F.abs(F.col("x") - 116 - k - km / 111.32 / float(np.cos(np.radians(40)))) < 1e-9)).count() == 1


def test_replay_and_tampering(spark):
    t = trust.TRANSITIONS
    ok = [("r1", i, *s, "e", "d") for i, s in enumerate(t[:5])]
    rows = ok + [("r2", i, *s, None if s[1] == "PUBLISH" else "e", "d") for i, s in enumerate(t[:5])] + [("r3", 0, *t[1], "e", "d")] + [("r4", 0, *t[0], "e", "d"), ("r4", 2, *t[1], "e", "d")]
    log = spark.createDataFrame(rows, "run string, seq int, from_state string, transition string, to_state string, evidence string, digest string")
    got = {r["run"]: (r["state"], r["broken_at"]) for r in states.replay(log, "run", "seq").collect()}
    assert got == {"r1": ("PUBLISHED", None), "r2": ("AUDITED", 4), "r3": ("BRIEFED", 0), "r4": ("RESOLVED", 2)}
    chain = trust.hash_chain(log, "run", "seq")
    assert states.verify(log, chain, "run", "seq").agg(F.sum("broken")).first()[0] == 0
    bad = log.withColumn("digest", F.when((F.col("run") == "r1") & (F.col("seq") == 1), "x").otherwise(F.col("digest")))
    assert {r["run"]: r["broken"] for r in states.verify(bad, chain, "run", "seq").collect()}["r1"] == 4
    assert states.replay(log.limit(0), "run", "seq").count() == 0


def test_reports_on_odd_rows(spark):
    faces = spark.createDataFrame([(1, None, "l", ""), (1, None, "l", ""), (2, "a", None, "x")], "face_id bigint, name string, source_layer string, geometry_wkt string")
    assert {r["check"]: r["value"] for r in reports.layer_checks(faces).collect()} == {"null_names": 1, "null_geometry": 1, "repeated_rows": 1, "layers": 1}
    assert reports.freeze_gold(spark.createDataFrame([], "case_id bigint, reviewer string, entity_sufficient boolean, boundary_sufficient boolean, conflict boolean")).count() == 0
    one = spark.createDataFrame([(1, "b", True, True, False), (1, "a", True, None, None)], "case_id bigint, reviewer string, entity_sufficient boolean, boundary_sufficient boolean, conflict boolean")
    assert reports.freeze_gold(one).first()["gold_state"] == "GOLD_PARTIAL" and reports.freeze_gold(one).first()["content_hash"] == reports.freeze_gold(one.orderBy("reviewer")).first()["content_hash"]
    s = spark.createDataFrame([(i, i / 100.0) for i in range(30)], "id bigint, v double")
    assert evaluation.binned_sample(s, "v", ["id"], 20).count() == 20 and evaluation.binned_sample(s.limit(0), "v", ["id"], 20).count() == 0
    m = areas.membership(spark.createDataFrame([(None, "POLYGON ((0 0, 1 0, 1 1, 0 0))", None, None, None, None)], "a string, b string, building_name string, compound_name string, listed boolean, crossed double"), "a", "b").first()
    assert m["confidence"] == 0 and m["level"] == "EXCLUDED"


def test_compliant_keeps_rows_without_code(spark):
    df = spark.createDataFrame([("MIL", 1.23456, 2.0), (None, 1.23456, 2.0), ("R", 1.0, 2.0)], "code string, x double, y double")
    assert [r["x"] for r in sinks.compliant(df, "code", "x", "y").orderBy("x").collect()] == [1.0, 1.235]


def test_points_within_large_region_and_hot_cell(spark):
    """A region as large as a country, with long edges, and 100 000 points in one cell."""
    big = spark.createDataFrame([(1, "POLYGON ((80 10, 130 12, 128 50, 85 48, 80 10))"), (2, "POLYGON ((116 39, 116.001 39, 116.001 39.001, 116 39))")], "id bigint, wkt string")
    pts = spark.range(100_000).select("id", (F.lit(116.0) + (F.col("id") % 10) * 1e-5).alias("x"), F.lit(39.0).alias("y") + (F.col("id") % 7) * 1e-5).toDF("id", "x", "y")
    got = proximity.points_within(pts, big).groupBy("region_id").count().collect()
    inside = sum(1 for i in range(100_000) if kernel.inside(np.array([[116, 39], [116.001, 39], [116.001, 39.001], [116, 39.0]]), 116.0 + (i % 10) * 1e-5, 39.0 + (i % 7) * 1e-5))
    n = {r["region_id"]: r["count"] for r in got}
    assert n[1] == 100_000 and n.get(2, 0) == inside




def test_prior_of_many_at_one_place(spark):
    t = time.time()
    f = spark.range(20_000).select(F.col("id").alias("seed_id"), (116 + F.col("id") % 2 / 100).alias("x"), F.lit(39.0).alias("y"), F.col("id").cast("double").alias("area_m2"))
    got = {r["seed_id"]: r["prior_m2"] for r in pipelines.knn_prior(f, f, 0.02).where("seed_id IN (0, 4, 7, 19999)").collect()}
    assert got == {0: 6.0, 4: 6.0, 7: 5.0, 19999: 5.0}  # the five smallest even or odd ids, itself left out
    assert time.time() - t < 60  # not the 200 million pairs


def test_nearest_of_many_at_one_place(spark):
    t = time.time()
    a = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") == 9, float("nan")).otherwise(116.0).alias("x"), F.lit(39.0).alias("y"))
    b = spark.range(20_001).select((F.col("id") + 5).alias("other"), F.when(F.col("id") == 0, 117.0).otherwise(116.01).alias("x"), F.lit(39.0).alias("y"))
    got = hypotheses.nearest(a, b, "k", 0.05).groupBy("other", F.round("dist", 6).alias("dist")).count().collect()
    assert [tuple(r) for r in got] == [(6, 0.01, 19_999)]  # a point without numbers has no nearest one
    assert time.time() - t < 60  # not the 400 million pairs


def test_proposals_of_many_at_one_place(spark):
    t = time.time()
    f = spark.range(3_000).select(F.col("id").alias("seed_id"), F.lit(116.0).alias("x"), F.when(F.col("id") < 2_999, 39.0).otherwise(39.003).alias("y"), F.lit(100.0).alias("area_m2"))
    b = spark.createDataFrame([(116.0, 39.0, 1.0), (116.0, 39.0, 2.0), (116.0, 38.998, 4.0)], "x double, y double, area_m2 double")
    p = pipelines.provider_hypotheses(f.select("seed_id", "x", "y", F.lit(5.0).alias("prior_m2")), f.withColumnRenamed("seed_id", "poly_id"), b)
    got = {r["provider"]: tuple(r)[1:] for r in p.groupBy("provider").agg(F.count("*"), F.countDistinct("seed_id"), F.max("area_m2"), F.round(F.max("seed_m"))).collect()}
    assert got == {"EXISTING": (3_000 * 2_999, 3_000, 100.0, 333.0), "CLUSTER": (2_999, 2_999, 7.0, 0.0), "AREA_PRIOR": (3_000, 3_000, 5.0, 0.0)}
    assert time.time() - t < 60


def boxes_of(spark, n):
    """n large boxes (even ids) and n small ones over their right edge, 2 x 1 and 0.5 x 1 steps."""
    d = spark.range(2 * n).select("id", F.lit("c").alias("city"), *[F.when(F.col("id") % 2 == 0, a).otherwise(b).alias(k) for k, a, b in (("x0", 0.0, 0.0015), ("x1", 0.002, 0.0025), ("y0", 0.0, 0.0), ("y1", 0.001, 0.001))])
    p = lambda x, y: F.concat_ws(" ", F.col(x), F.col(y))
    return d.withColumn("wkt", F.concat(F.lit("POLYGON (("), F.concat_ws(", ", p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0")), F.lit("))")))


def test_topology_of_many_equal_shapes(spark):
    t, n = time.time(), 1_500
    p = areas.topology_pairs(boxes_of(spark, n), "id", "city", "wkt", 0.0005, 0.005)
    got = {r[0]: r[1:] for r in p.groupBy(F.round("overlap_m2", -1).cast("int").alias("m2")).agg(F.count("*"), F.max(F.col("id_a") - F.col("id_b")), F.max("gap_m")).collect()}
    full = lambda w: round(w * 0.001 * 111_000**2, -1)
    each = n * (n - 1) // 2
    assert {k: (v[0], v[2]) for k, v in got.items()} == {full(0.002): (each, 0), full(0.001): (each, 0), full(0.0005): (n * n, 0)} and all(v[1] < 0 for v in got.values())
    assert time.time() - t < 60  # not 4.5 million measurements


def test_topology_report_of_many_equal_shapes(spark):
    t, n = time.time(), 1_500
    s = areas.topology_report(areas.topology_pairs(boxes_of(spark, n), "id", "city", "wkt", 0.0005, 0.005)).first()
    m2 = 0.001 * 111_000**2 * (n * (n - 1) // 2 * 0.003 + n * n * 0.0005)
    assert s["n_overlaps"] == n * (2 * n - 1) and abs(s["total_overlap_m2"] / m2 - 1) < 1e-9 and s["n_gaps"] == s["n_shared"] == 0
    assert time.time() - t < 60


def test_topology_totals_count_members(spark):
    t, n = time.time(), 20_000
    s = areas.topology_totals(boxes_of(spark, n), "id", "city", "wkt", 0.0005, 0.005).first()
    m2 = 0.001 * 111_000**2 * (n * (n - 1) // 2 * 0.003 + n * n * 0.0005)
    assert s["n_overlaps"] == n * (2 * n - 1) and abs(s["total_overlap_m2"] / m2 - 1) < 1e-9 and s["n_gaps"] == s["n_shared"] == 0
    assert time.time() - t < 60  # not 800 million pairs


def test_totals_are_those_of_the_pairs(spark):
    rng = random.Random(9)
    at = [(rng.randrange(6) * 0.001, rng.randrange(6) * 0.001, rng.choice((0.001, 0.0008, 0.002))) for _ in range(60)] * 2
    rows = [(k, rng.choice("pq"), x, y, x + w, y + 0.001, kernel.to_wkt(np.array([[x, y], [x + w, y], [x + w, y + 0.001], [x, y + 0.001], [x, y]]))) for k, (x, y, w) in enumerate(at)]
    d = spark.createDataFrame([*rows, (None, *rows[0][1:])], "id int, city string, x0 double, y0 double, x1 double, y1 double, wkt string")
    args = (d, "id", "city", "wkt", 0.0005, 0.005)
    a, b = areas.topology_totals(*args).first(), areas.topology_report(areas.topology_pairs(*args)).first()
    assert all(a[k] > 0 and abs(a[k] - b[k]) <= 1e-9 * b[k] for k in a.asDict())


def test_repairs_of_many_equal_shapes(spark):
    t, n = time.time(), 1_500
    forms = areas.shape_forms(boxes_of(spark, n), "id", "city", "wkt")
    p = areas.repairs(areas.form_pairs(forms, "id", "city", "wkt", 0.0005, 0.005), F.lit(False))
    p = areas.of_members(p.select("form_a", "form_b", "operation", (pos.wkt_area("geometry") * 1e6).alias("left")), forms, "id")
    got = {tuple(r) for r in p.groupBy(F.col("id_a") % 2, F.col("id_b") % 2, "operation", F.round("left", 3)).count().collect()}
    each, lower = n * (n - 1) // 2, n * (n + 1) // 2  # an even id comes before so many odd ones
    # what the first one has beside the second
    assert got == {(0, 0, "REMOVE_OVERLAP", 0.0, each), (1, 1, "REMOVE_OVERLAP", 0.0, each), (0, 1, "REMOVE_OVERLAP", 1.5, lower), (1, 0, "REMOVE_OVERLAP", 0.5, each)}
    assert time.time() - t < 60


def test_many_rings_like_one_by_one():
    rng = random.Random(3)
    rings = [star(rng, 5, 5, n, 0.5 + rng.random()) for n in (3, 4, 5, 8, 12) for _ in range(40)]
    rings += [np.array([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0.0]]), np.array([[0, 0], [1, 1], [2, 2], [0, 0.0]]), np.ones((5, 2)), np.array([[0, 0], [3, 0], [3, 1], [0, 1], [0, 0.0]]), star(rng, n=200), None]
    each = lambda f: kernel.in_groups(rings, f, None)
    got = list(zip(rings, each(kernel.are_valid), each(kernel.hull_ratios), each(lambda q: list(zip(*kernel.min_rectangles(q), strict=True))), each(kernel.inscribed_radii), strict=True))
    assert got[-1] == (None,) * 5
    for q, valid, hull, sides, radius in got[:-1]:
        assert valid == kernel.is_valid(q) and abs(radius - kernel.inscribed_radius(q)) <= 0.0051 * max(np.ptp(q, axis=0))
        assert np.allclose(np.prod(sides), np.prod(kernel.min_rectangle(q))) and np.isclose(hull, abs(kernel.area(q)) / max(abs(kernel.area(kernel.convex_hull(q))), 1e-300))


def test_measures_of_many_boxes(spark):
    t = time.time()
    d = spark.range(40_000).select(F.expr("concat('POLYGON ((0 0, ', id + 2, ' 0, ', id + 2, ' 2, 0 2, 0 0))')").alias("w"), "id").repartition(4)
    r = d.select("id", kernel.wkt_aspect("w").alias("a"), kernel.wkt_inscribed("w").alias("r"), kernel.wkt_valid("w").alias("v")).agg(F.max(F.abs(F.col("a") - (F.col("id") + 2) / 2)), F.min("r"), F.max("r"), F.count_if("v")).first()
    assert r[0] < 1e-9 and r[1] == 1.0 and r[2] == 1.0 and r[3] == 40_000
    assert time.time() - t < 60


def test_profiles_of_many_records(spark):
    t = time.time()
    rng = random.Random(5)
    shapes = [kernel.to_wkt(star(rng, 116, 39, 8, 0.002)) for _ in range(500)]
    d = spark.createDataFrame([(w,) for w in shapes], "w string").crossJoin(spark.range(120)).repartition(4)
    p = d.select(kernel.wkt_profile("w").alias("p")).agg(F.count_if("p.valid"), F.count_if(F.expr("p.width_m > 0 and p.length_m > p.width_m and p.aspect >= 1"))).first()
    assert p[0] > 50_000 and p[1] == 60_000
    assert time.time() - t < 30  # 60,000 profiles


def test_quality_of_records_searches_few_circles(spark, monkeypatch):
    rng = random.Random(8)
    rings = [np.round(star(rng, 116, 39, 5, r), 5) for r in (0.0002, 0.002) for _ in range(150)] + [np.array([[116, 39], [116.002, 39], [116.002, 39 + h], [116, 39 + h], [116, 39]]) for h in (1e-5, 4e-4, 6e-4)]
    searched, search = [], kernel.inscribed_radii
    monkeypatch.setattr(kernel, "inscribed_radii", lambda q: searched.append(len(q)) or search(q))
    got = kernel.in_groups(rings, lambda q: kernel._tested(q, np.full(len(q), 12.0), (50.0, 100.0), 0.3), None)
    assert 0 < sum(searched) < len(rings) / 2
    narrow = lambda p: (p[0], p[1], p[3], p[2] < 50 and p[1] > 100, p[2] > 1 and 12.0 < 0.3 * p[2])
    assert [narrow(p) for p in got] == [narrow(p) for p in kernel.in_groups(rings, kernel._profiles, None)]
    d = spark.createDataFrame([(kernel.to_wkt(q), 12.0) for q in rings] + [("POINT (1 2)", None), (None, None)], "w string, m double")
    rows = d.select(kernel.wkt_tested(F.col("w"), F.col("m"), (50.0, 100.0), 0.3).alias("p")).collect()
    assert [r.p["valid"] for r in rows] == [p[0] for p in got] + [None, None]
