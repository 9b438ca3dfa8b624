"""Scalar goldens, laws and metamorphic checks of the core."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadastra.functions import columns, crs, kernel, metres, polygons, rings, text
from cadastra.operators import evaluation, gates, graph, hypotheses, landuse, profile, proximity, quality, relations, trust
from cadastra.sources import readers, sinks

SQUARE = "POLYGON ((116 39, 116.01 39, 116.01 39.01, 116 39.01, 116 39))"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize("wkt, ok", [
    (SQUARE, True), ("srid=4326; polygon((116 39,116.01 39,116.01 39.01,116 39))", True), ("MULTIPOLYGON (((1 4, 2 4, 2 5, 1 4)))", False), ("POLYGON ((116 39, 116.01 39, 116.01 39.01", False),
    ("POLYGON EMPTY", False), ("", False), (None, False), ("POLYGON [116 39]]", False), ('{"type":"Polygon"}', False), ("POLYGON ((39 116, 39 117, 40 117, 39 116))", False),
    ("MULTIPOLYGON(((116 39, 117 39, 117 40, 116 39)), ((100 30, 101 30, 101 31, 100 30), (100.1 30.1, 100.2 30.1, 100.2 30.2, 100.1 30.1)))", True),
])
def test_usable_polygon(spark, wkt, ok):
    assert (one(spark, columns.usable_box(F.lit(wkt).cast("string")))[0] is not None) == ok


def test_long_polygon(spark):
    ring = ", ".join(f"{116 + i / 1e6} 39" for i in range(20_000))
    assert one(spark, columns.usable_box(F.lit(f"POLYGON (({ring}, 116 39))")))[0] is not None


def test_ids_and_blanks(spark):
    assert one(spark, columns.norm_id(F.lit(" 　src_1\t")), columns.is_blank(F.lit("​")), columns.is_blank(F.lit("N/A")), columns.is_blank(F.lit("x")))[:] == ("SRC_1", True, True, False)


def brute_near(rows, metres_):
    out = set()
    for i, (a, x, y) in enumerate(rows):
        for b, u, v in rows[i + 1 :]:
            h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
            if 2 * columns.EARTH_M * math.asin(math.sqrt(h)) <= metres_:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("lat", [0.0, 39.9, -60.0, 80.0])
def test_near_pairs(spark, lat):
    rng = np.random.default_rng(7)
    rows = [(f"r{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(116, 116.003, 250), lat + rng.uniform(0, 0.002, 250), strict=True))] + [("n1", None, 1.0), ("n2", float("nan"), 1.0), ("z1", 116.0, lat), ("z2", 116.0, lat)]
    df = spark.createDataFrame(rows, "id string, x double, y double")
    got = [tuple(r) for r in proximity.near_pairs(df, 25.0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near([r for r in rows if r[1] is not None and r[1] == r[1]], 25.0)


def test_near_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(proximity, "PIECE_ROWS", 10)
    df = spark.createDataFrame([(f"a{i:02d}", 116.0, 39.0) for i in range(45)], "id string, x double, y double")
    assert proximity.near_pairs(df, 25.0).distinct().count() == 45 * 44 // 2 == proximity.near_pairs(df, 25.0).count()


def test_near_empty(spark):
    assert proximity.near_pairs(spark.createDataFrame([], "id string, x double, y double"), 25.0).count() == 0


def test_points_within(spark):
    rng = np.random.default_rng(3)
    hole = "POLYGON ((116 39, 116.02 39, 116.02 39.02, 116 39.02, 116 39), (116.005 39.005, 116.015 39.005, 116.015 39.015, 116.005 39.015, 116.005 39.005))"
    multi = "MULTIPOLYGON (((116.03 39, 116.05 39.01, 116.03 39.02, 116.03 39)), ((116.06 39, 116.07 39, 116.065 39.01, 116.06 39)))"
    shapes = {"h": hole, "m": multi, "bow": "POLYGON ((116 39.03, 116.02 39.05, 116.02 39.03, 116 39.05, 116 39.03))"}
    pts = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(115.99, 116.08, 800), rng.uniform(38.99, 39.06, 800), strict=True))]
    want = set()
    for k, w in shapes.items():
        for p, x, y in pts:
            if any(sum(kernel.inside(r, x, y) for r in part) % 2 for part in polygons.parse_polygons(w)):
                want.add((k, p))
    regions = spark.createDataFrame([*shapes.items(), ("bad", "POLYGON EMPTY"), ("none", None), ("h", hole)], "id string, wkt string")
    got = proximity.points_within(spark.createDataFrame(pts, "id string, x double, y double"), regions).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_profile_departures(spark):
    rows = []
    for load in range(5):
        for i in range(40):
            lng, area, wkt = 116 + i / 1e4 + 0.000037, 3000.0 + i, SQUARE.replace("39.01", f"39.0{i + 10}")
            if load == 4:
                lng, area, wkt = (round(lng, 2), 4.5, "POLYGON ((116 39") if i < 20 else (lng, area, wkt)
            if load == 3 and i < 20:
                lng, area, wkt = None, float("nan"), SQUARE
            rows.append(("sys", f"b{load}", lng, area, wkt, "x"))
    df = spark.createDataFrame(rows, "source_system string, source_batch_id string, point_raw_lng double, area_raw double, geometry_raw_wkt string, mask string")
    got = {tuple(r) for r in profile.departures(df).collect()}
    assert got == {("B4", "point_raw_lng", "format"), ("B4", "area_raw", "range"), ("B4", "geometry_raw_wkt", "format"), ("B3", "point_raw_lng", "missing"), ("B3", "area_raw", "missing"), ("B3", "geometry_raw_wkt", "repeat")} | ({("B4", "area_raw", "repeat")} & got)
    assert profile.departures(df.limit(0)).count() == 0
    p = profile.mask_profile(df).collect()
    assert len(p) == 15 and max(p, key=lambda r: r["divergence"])["source_batch_id"] in ("B3", "B4")


def test_profile_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, None)] * 40, "source_system string, source_batch_id string, point_raw_lng double, area_raw double, geometry_raw_wkt string")
    assert profile.departures(df).count() == 0  # the load is its own median


def test_crs_round_trip(spark):
    g = crs.wgs84_to_gcj02(F.lit(116.397), F.lit(39.909))
    b = crs.gcj02_to_wgs84(g["lng"], g["lat"])
    r = one(spark, b["lng"], b["lat"], crs.wgs84_to_gcj02(F.lit(2.0), F.lit(48.0))["lng"], g["lng"])
    assert abs(r[0] - 116.397) < 1e-5 and abs(r[1] - 39.909) < 1e-5 and r[2] == 2.0 and 0.004 < r[3] - 116.397 < 0.008


def test_utm_round_trip(spark):
    u = metres.utm_forward(F.lit(116.4), F.lit(39.9), F.lit(50))
    b = metres.utm_inverse(u["east"], u["north"], F.lit(50))
    r = one(spark, u["east"], u["north"], b["lng"], b["lat"])
    assert abs(r[2] - 116.4) < 1e-9 and abs(r[3] - 39.9) < 1e-9 and abs(r[0] - 448694.0) < 30 and abs(r[1] - 4416855.0) < 300


def test_measures(spark):
    m = one(spark, rings.measures(rings.ring_of(F.lit(SQUARE))), rings.metric(rings.measures(rings.ring_of(F.lit(SQUARE)))))
    assert abs(m[0]["area"] - 1e-4) < 1e-12 and abs(m[0]["cx"] - 116.005) < 1e-9 and 0.9e6 < m[1]["area_m2"] < 1.0e6


@settings(max_examples=30, deadline=None)
@given(st.integers(3, 12), st.integers(0, 10_000), st.floats(-500, 500), st.floats(-500, 500))
def test_kernel_laws(n, seed, dx, dy):
    rng = np.random.default_rng(seed)
    a = np.sort(rng.uniform(0, 2 * math.pi, n))
    r = np.column_stack([np.cos(a), np.sin(a)]) * rng.uniform(0.5, 2, n)[:, None]
    ring = np.vstack((r, r[:1]))
    hull = kernel.convex_hull(r)
    if abs(kernel.area(ring)) < 1e-3 or not kernel.is_valid(ring):
        return
    assert abs(abs(kernel.area(ring + [dx, dy])) - abs(kernel.area(ring))) < 1e-6
    assert abs(kernel.area(hull)) >= abs(kernel.area(ring)) - 1e-9
    assert abs(kernel.iou(ring, ring)[0] - 1) < 1e-6
    other = ring + [0.3, 0.1]
    assert abs(kernel.overlap_area(ring, other) - kernel.overlap_area(other, ring)) < 1e-6
    long, short = kernel.min_rectangle(r)
    assert long * short >= abs(kernel.area(hull)) - 1e-9 and kernel.inscribed_radius(ring) <= short / 2 + 0.01 * long


def test_heal_and_hull():
    bow = np.array([[0, 0], [1, 1], [1, 0], [0, 1], [0, 0.0]])
    assert not kernel.is_valid(bow) and kernel.is_valid(kernel.heal(bow))
    pts = np.array([[x, y] for x in np.linspace(0, 2, 9) for y in np.linspace(0, 2, 9) if x <= 1 or y <= 1])
    c = kernel.concave_hull(pts, 0.5)
    assert kernel.is_valid(c) and 0.5 * abs(kernel.area(kernel.convex_hull(pts))) < abs(kernel.area(c)) < 0.995 * abs(kernel.area(kernel.convex_hull(pts)))


def test_names(spark):
    c = text.components(F.lit("万科城市花园甲2号院3号楼一期"))
    r = one(spark, c, text.numeral(F.lit("四十三")), text.numeral(F.lit("一百零五")), text.normal_token(F.lit("A1区")), text.entity_type(F.lit("第一设计院宿舍")), text.name_prefix(F.lit("(东)万科城市")), text.tokens(F.lit("万科星河湾一期(南区)")))
    assert r[0]["parts"] == {"court": "甲2", "building": "3", "phase": "1"} and r[0]["base"] == "万科城市花园"
    assert r[1:6] == (43, 105, "A1", "RESIDENTIAL_DORMITORY", "万科城") and r[6]["base_name"] == "万科星河湾" and r[6]["phase"] == "一期" and r[6]["subarea"] == "南区"
    d = spark.createDataFrame([("东四十条", "东四十三条"), (None, "x")], "a string, b string").select(F.round(text.sequence_ratio("a", "b"), 4)).collect()
    assert [x[0] for x in d] == [0.8889, 0.0]


def test_component_conflicts(spark):
    a, b = (text.components(F.lit(x))["parts"] for x in ("和平9号院一期", "和平5号院二期"))
    assert one(spark, text.component_conflicts(a, b))[0] == ["court", "phase"]


def test_lenient_json(spark):
    for t in ('{"a": 1}', 'said ```json\n{"a": 1}\n``` ok', 'x {"a": 1} y'):
        assert one(spark, text.lenient_json(F.lit(t), "a int"))[0]["a"] == 1
    assert one(spark, text.lenient_json(F.lit("none"), "a int"))[0] is None


def test_lattice_laws(spark):
    ds = [(a, b, c) for a in trust.LATTICE for b in trust.LATTICE for c in trust.LATTICE]
    df = spark.createDataFrame(ds, "a string, b string, c string")
    j, m = trust.join_, trust.meet
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    bad = df.where((j(a, b) != j(b, a)) | (j(a, j(b, c)) != j(j(a, b), c)) | (j(a, a) != a) | (m(a, j(a, b)) != a) | (j(a, m(a, b)) != a))
    assert bad.count() == 0


def test_masses(spark):
    item = lambda s: F.struct(F.lit(0.6 if s else 0.0).alias("h"), F.lit(0.0 if s else 0.6).alias("n"), F.lit(0.4).alias("u"))
    for s, f in ((0, 0), (1, 0), (3, 2), (0, 4), (5, 1)):
        fold = trust.fold_masses(F.array(*[item(True)] * s, *[item(False)] * f)) if s + f else F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("n"), F.lit(1.0).alias("u"))
        x, y = one(spark, fold, trust.count_masses(F.lit(s), F.lit(f)))
        assert all(abs(x[k] - y[k]) < 1e-12 for k in "hnu") and 0 <= y["conflict"] <= 1
    sure = lambda h: F.struct(F.lit(h).alias("h"), F.lit(1 - h).alias("n"), F.lit(0.0).alias("u"))
    assert one(spark, trust.combine_masses(sure(1.0), sure(0.0)))[0]["u"] == 1.0


def test_ledger(spark):
    rows = [(1, 1, 11, "SUPPORTING", "GEOMETRY", []), (1, 2, 12, "SUPPORTING", "AUDIT", []), (2, 1, 21, "REFUTING", "AUDIT", []), (2, 2, 22, "SUPPORTING", "AUDIT", [21]), (3, 1, 31, "SUPPORTING", "AUDIT", [31])]
    df = spark.createDataFrame(rows, "entity_id int, seq int, evidence_id int, kind string, category string, overrides array<int>")
    got = {r["entity_id"]: (r["disposition"], r["active"]) for r in trust.ledger_disposition(df).collect()}
    assert got == {1: ("TRUSTED", 2), 2: ("UNRESOLVED", 1), 3: ("UNRESOLVED", 0)}
    assert trust.ledger_snapshots(df).where("false_trust").count() == 0


def test_hash_chain_tamper(spark):
    df = spark.createDataFrame([(r, s, f"e{s}", "clock") for r in ("a", "b") for s in range(5)], "run_id string, seq int, event string, occurred_at string")
    c = trust.hash_chain(df)
    assert trust.broken_links(c).count() == 0
    assert c.select("event_hash").distinct().count() == 5  # equal runs have equal chains, whatever the clock
    assert trust.broken_links(c.withColumn("event_hash", F.when((F.col("run_id") == "a") & (F.col("seq") == 2), "x").otherwise(F.col("event_hash")))).count() == 1


def test_gate_spec_errors():
    for bad in ({"gate_id": "x"}, {"gate_id": "x", "must": {"node": "what"}}, {"gate_id": "x", "must": {"node": "fact", "fact": "a", "op": "near"}}, {"gate_id": "x", "must": {"node": "all_of", "children": []}}):
        with pytest.raises(ValueError):
            gates.check_spec(bad)


MATRIX = [  # case, type, role, valid, area, compactness, evidence, score -> disposition, visit
    ("V01", "COMPOUND", "LEGAL", True, 9.5e5, 0.7, ["OSM", "MSB"], 0.9, "TRUSTED", "READY"), ("V02", "COMPOUND", "LEGAL", False, 9.5e5, 0.7, ["OSM"], 0.9, "REJECTED", "NOT_READY"),
    ("V03", "NOPE", "LEGAL", True, 9.5e5, 0.7, ["OSM"], 0.9, "REJECTED", "NOT_READY"), ("V04", "COMPOUND", "LEGAL", True, 9.5e5, 0.7, [], 0.9, "UNRESOLVED", "NOT_READY"),
    ("V05", "COMPOUND", "LEGAL", True, 9.5e5, 0.7, ["AreaPriorBaseline"], 0.65, "PROVISIONAL", "READY_WITH_WARNING"), ("V06", "COMPOUND", "LEGAL", True, 9.5e5, 0.01, ["OSM"], 0.7, "PROVISIONAL", "READY_WITH_WARNING"),
    ("V07", "RESIDENTIAL_ESTATE", "PHYSICAL_BOUNDARY", True, 9.5e5, 0.7, ["OSM"], 0.75, "PROVISIONAL", "READY_WITH_WARNING"), ("V08", "COMPOUND", "LEGAL", True, 9.5e9, 0.7, ["OSM"], 0.9, "REJECTED", "NOT_READY"),
]


def test_validation_matrix(spark):
    df = spark.createDataFrame([(*m[:8], False, False) for m in MATRIX], "id string, entity_type string, boundary_role string, geometry_valid boolean, area_m2 double, compactness double, evidence_sources array<string>, score double, geometry_empty boolean, parse_error boolean")
    df = df.withColumns({"evidence_contents": F.col("evidence_sources"), "evidence_n": F.size("evidence_sources"), "sole_source": F.try_element_at("evidence_sources", F.lit(1))})
    df = df.withColumns({"o": gates.gate(gates.ONTOLOGY)["status"], "g": gates.gate(gates.GEOMETRY)["status"], "e": gates.gate(gates.EVIDENCE)["status"]})
    df = df.withColumns({"disposition": gates.final_disposition(F.col("o"), F.col("g"), F.col("e")), "warned": (F.col("o") == "WARNED") | (F.col("g") == "WARNED") | (F.col("e") == "WARNED")})
    df = df.withColumn("visit", gates.readiness(F.col("disposition"), F.col("score"), F.col("warned"), F.lit(0.5), F.lit(True), F.lit(False)))
    assert {r["id"]: (r["disposition"], r["visit"]) for r in df.collect()} == {m[0]: m[8:] for m in MATRIX}


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = graph.connected_components(spark.range(103), spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: 0 if i <= 60 else 100 if i in (100, 101) else i for i in range(103)}


def test_box_pairs_partitioning(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "c", float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(rng.uniform(0, 1, 200), rng.uniform(0, 1, 200), rng.uniform(0, 0.05, 200), rng.uniform(0, 0.05, 200), strict=True))] + [(900, "c", -1.0, -1.0, 2.0, 2.0)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    got = relations.box_pairs(spark.createDataFrame(rows, "id int, g string, x0 double, y0 double, x1 double, y1 double"), "id", "g", 0.01).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_landuse(spark):
    rows = [("landuse", "park", "回龙观体育公园", "A4", "NAME_OVERRIDE"), ("landuse", "park", "太平郊野公园", "G", "TRUSTED_TAG"), ("landuse", "forest", "", "G", "TRUSTED_TAG"), ("landuse", "residential", "某某镇卫生院", "A5", "NAME_OVERRIDE"), ("landuse", "park", "公园悦府小区东侧社区公园", "G", "TRUSTED_TAG")]
    df = spark.createDataFrame(rows, "layer string, tag string, name string, code string, status string")
    null = F.lit(None).cast("string")
    h = landuse.hygiene(F.col("layer"), F.col("tag"), F.col("name"), null, null, null)
    assert df.where((h["code"] != F.col("code")) | (h["status"] != F.col("status"))).count() == 0
    v = landuse.hygiene(F.lit("landuse"), F.lit("recreation_ground"), F.lit(""), null, null, F.lit("A4"))
    assert one(spark, v)[0]["status"] == "POI_VOTE"


def test_scores(spark):
    r = one(spark, hypotheses.constraints(F.lit("ESTATE"), F.lit(None).cast("double"))["radius"], hypotheses.constraints(F.lit("ESTATE"), F.lit(10_000.0))["least"], hypotheses.topology(F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(True)), quality.decision(F.lit(0.7)))
    assert r[:] == (700.0, 4000.0, "SEPARATED_BY", "PASS")


def test_calibration_edges(spark):
    p = spark.createDataFrame([(1.0, True), (0.05, False)], "confidence double, correct boolean")
    assert sum(r["n"] for r in evaluation.calibration_bins(p, "confidence", "correct").collect()) == 1
    assert sum(r["n"] for r in evaluation.calibration_bins(p, "confidence", "correct", clamp_last=True).collect()) == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"x"},"geometry":{"type":"Polygon","coordinates":[[[116,39],[117,39],[117,40],[116,39]]]}},{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}]}')
    g = readers.read_geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert g[0]["wkt"] == "POLYGON ((116.0 39.0, 117.0 39.0, 117.0 40.0, 116.0 39.0))" and g[1]["wkt"] is None
    (tmp_path / "o.json").write_text('{"elements":[{"type":"way","id":1,"geometry":[{"lat":1,"lon":2},{"lat":1,"lon":3},{"lat":2,"lon":3},{"lat":1,"lon":2}],"tags":{"highway":"primary","name":"n"}},{"type":"way","id":2,"bounds":{"minlat":1,"minlon":2,"maxlat":3,"maxlon":4}},{"type":"node","id":3}]}')
    o = {r["way_id"]: r for r in readers.read_overpass(spark, str(tmp_path / "o.json")).collect()}
    assert o[1]["wkt"].startswith("POLYGON") and o[2]["wkt"].startswith("LINESTRING") and o[1]["features"] == ["osm/way/1", "n", "highway=primary"]
    page = "L.polygon([[39,116],[39,117],[40,117]],{}).bindTooltip('<b>A&amp;B</b>');L.polygon([[1,2],[3,4]])"
    assert readers.html_polygons(page) == [("A&B", "POLYGON ((116 39, 117 39, 117 40, 116 39))")]
    w = spark.createDataFrame([("c1", "名", "116.1", "nan", "板楼")], "`小区编码` string, `小区名称` string, `经度` string, `纬度` string, `小区建筑类型` string")
    rec = readers.from_workbook(w, "B1").first()
    assert rec["source_record_id"] == "SRC_000001" and rec["point_raw_lng"] == 116.1 and rec["point_raw_lat"] is None and rec["attributes_raw"] == {"小区建筑类型": "板楼"}
    s = readers.sample_records(spark)
    sinks.write_geojson_lines(s.select("source_record_id", "geometry_raw_wkt"), "geometry_raw_wkt", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 30
    sinks.write_by_class(spark.createDataFrame([("[A4] x", [1, 2]), ("y", [3])], "label string, xs array<int>"), "label", str(tmp_path / "cls"))
    assert {r["gb_class"] for r in spark.read.option("header", True).csv(str(tmp_path / "cls")).collect()} == {"A4", "_uncategorized"}


def test_stream(spark, tmp_path):
    from cadastra.streaming.ledger import append_ledger

    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.sql("SELECT 'e1' AS evidence_id, 'SUPPORTING' AS kind, TIMESTAMP'2026-01-01 00:00:00' AS recorded_at UNION ALL SELECT 'e1', 'SUPPORTING', TIMESTAMP'2026-01-01 00:01:00' UNION ALL SELECT 'e2', 'REFUTING', TIMESTAMP'2026-01-01 00:02:00'").write.parquet(src)
    for _ in range(2):  # a restart writes nothing twice
        append_ledger(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_provider_proposals_of_all_fences(spark, data):
    from cadastra.plans import reference, views

    f = [(r["id"], r["lng"], r["lat"]) for r in views.fences(spark, data).collect()]
    got = {r["provider"]: (r["n"], r["seeds"]) for r in reference.provider_proposals(spark, data).collect()}
    near = lambda a, b: math.hypot((a[1] - b[1]) * math.cos(math.radians(a[2])), a[2] - b[2]) * hypotheses.FLAT <= 500
    pairs = [(a[0], b[0]) for a in f for b in f if a[0] != b[0] and near(a, b)]
    assert got.get("EXISTING", (0, 0)) == (len(pairs), len({a for a, _ in pairs})) and got["AREA_PRIOR"][0] > len(f) / 3
