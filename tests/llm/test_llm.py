"""The operators of training-data preparation against brute force, round trips and held-out accuracy."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import addresses, components, matching, mixing, pairs, subjects, survivors, tokens, variants
from cadastra.llm.address_parts import parse_address
from cadastra.llm.hanzi import fold, number
from cadastra.llm.name_parts import parse_name

REL = "relation_id string, subject_record_id string, object_record_id string, relation_type string, created_at timestamp, note string"
REC = "source_record_id string, source_system string, source_batch_id string, ingested_at timestamp, name_raw string, address_raw string, province_raw string, city_raw string, district_raw string, street_raw string, point_raw_lng double, point_raw_lat double, geometry_raw_wkt string, area_raw double, bag string"
ENT = "canonical_entity_id string, canonical_name string, province string, city string, district string, street string, member_source_record_ids array<string>, updated_at timestamp"


def brute_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("seed", [1, 2])
def test_hash_to_min(spark, seed):
    rng = random.Random(seed)
    ids = [f"r{i:04d}" for i in range(200)]
    links = [(ids[i], ids[i + 1]) for i in range(0, 60)] + [(rng.choice(ids[61:]), rng.choice(ids[61:])) for _ in range(80)] + [("hub", x) for x in ids[150:]]
    links += links[:10] + [(b, a) for a, b in links[:10]]
    got = components.hash_to_min(spark.createDataFrame([*links, (None, "x"), ("x", None)], "a string, b string")).collect()
    want = brute_components([e for e in links])
    assert {r["id"]: r["group_id"] for r in got} == want and len(got) == len(want)


def test_relation_groups(spark):
    import datetime as dt

    t = lambda n: dt.datetime(2026, 1, n)
    rows = [("R1", " src_1 ", "SRC_2", "exact_duplicate ", t(1), None), ("R1", "SRC_1", "SRC_2", "NOT_SAME_ENTITY", t(2), None), ("r2", "SRC_3", "src_4", "SAME_ENTITY_ALT_BOUNDARY", t(1), None), ("R3", "SRC_4", "SRC_3", "EXACT_DUPLICATE", t(1), None),
            ("R4", "SRC_5", "src_5", "EXACT_DUPLICATE", t(1), None), ("R5", "SRC_6", None, "EXACT_DUPLICATE", t(1), None), ("R6", "SRC_4", "SRC_7", "EXACT_DUPLICATE", None, None), (None, "SRC_8", "SRC_9", "EXACT_DUPLICATE", t(1), None)]
    got = {tuple(r) for r in components.relation_groups(spark.createDataFrame(rows, REL)).collect()}
    assert got == {("SRC_3", "SRC_3"), ("SRC_4", "SRC_3"), ("SRC_7", "SRC_3"), ("SRC_8", "SRC_8"), ("SRC_9", "SRC_8")}
    assert components.relation_groups(spark.createDataFrame([], REL)).count() == 0


def test_best_of_group(spark):
    rng = random.Random(4)
    rows = [(f"g{rng.randrange(40)}", f"k{i:04d}", rng.choice([None, 1, 2]), rng.choice([1, 2]), rng.choice([None, 1.0, 2.0])) for i in range(150)]
    want = set()
    z = lambda v: float("-inf") if v is None else v
    for g in {r[0] for r in rows}:
        m = [r for r in rows if r[0] == g]
        for a in m:
            if len(m) > 1 and all(all(z(x) >= z(y) for x, y in zip(a[2:], b[2:])) and any(z(x) > z(y) for x, y in zip(a[2:], b[2:])) for b in m if b is not a):
                want.add((g, a[1]))
    df = spark.createDataFrame(rows, "g string, k string, a int, b int, c double")
    assert {tuple(r) for r in survivors.best_of_group(df, "g", "k", ["a", "b", "c"]).collect()} == want
    assert survivors.best_of_group(df, "g", "k", ["a", "b", "c"], strict=False).count() == len({r[0] for r in rows})
    assert survivors.best_of_group(df.limit(0), "g", "k", ["a", "b", "c"]).count() == 0


def test_group_pairs_hot(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PIECE", 7)
    df = spark.createDataFrame([("hot", f"a{i:02d}") for i in range(40)] + [("x", "b1"), ("x", "b2"), ("y", "c")], "k string, id string")
    got = [(r["id_a"], r["id_b"]) for r in pairs.group_pairs(df, ["k"], "id").collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2 + 1
    j = pairs.group_join(df, spark.createDataFrame([("hot", 1), ("hot", 2), ("y", 3)], "k string, v int"), ["k"], "id").collect()
    assert len(j) == 81


@pytest.mark.parametrize("a, b", [("二百零五", 205), ("十三", 13), ("四十", 40), ("３".translate({0xFF13: "3"}), 3), ("iv", 4), ("一百一十", 110), ("y", None), ("", None)])
def test_numbers(a, b):
    assert number(a) == b


@pytest.mark.parametrize("name, like", [
    ("Biyinglang Dasha Equ", "碧映朗大厦E区"), ("(E区)-碧映朗大厦", "碧映朗大厦E区"), ("枫枫和碧小区1期", "枫和碧小区一期"), ("市九棉家属院", "第九棉纺厂家属院"), ("棉九家属", "第九棉纺厂家属院"), ("星星湖瑞公寓No.5院", "星湖瑞公寓5号院"),
    ("颐謹家园", "颐谨家园"), ("榕瑞岚嘉园III期居委会", "榕瑞岚嘉园三期"), ("蓝奚公寓9号院（原）", "蓝溪公寓9号院"), ("澄川·庭听蓝新村北區 东门", "庭听蓝新村北区"), ("苑·云 铂", "云铂苑"), ("港港臻碧大夏", "港臻碧大厦"),
])
def test_name_variants(name, like):
    a, b = parse_name(name, "云峤省", "澄川市", "东坳县"), parse_name(like, "云峤省", "澄川市", "东坳县")
    assert (a.kind, a.bag, a.parts) == (b.kind, b.bag, b.parts) and set(a.ends.split("|")) & set(b.ends.split("|"))


@pytest.mark.parametrize("a, b", [("万科一期", "万科二期"), ("颐府北区", "颐府南区"), ("第三棉纺厂宿舍", "第四棉纺厂宿舍"), ("颐府6号院", "颐府")])
def test_other_places(a, b):
    x, y = parse_name(a), parse_name(b)
    assert (x.bag, x.parts) != (y.bag, y.parts)


@pytest.mark.parametrize("text", ["", "  ", "未知", "N/A", "null", None, "​", "-"])
def test_blank_names(text):
    assert parse_name(text).kind == ""


def test_odd_names():
    for t in ("期", "院", "号院", "第", "厂", "123", "a", "府", "🏠", "x" * 100_000, "省" * 5000, "第一期第二期三期"):
        parse_name(t, t[:5], t[:5], t[:5])
        parse_address(t, t[:5], t[:5], t[:5], t[:5])


@pytest.mark.parametrize("address, door", [
    ("云栈市樱荫二巷310号 11-2-1487", "310"), ("154# 茶风街, 云栈市, 阑原省 旁边公厕对面", "154"), ("樱荫二巷", ""), ("樱荫二巷乙五十六号", "乙56"), ("东岗区兰渡西路No.54二号楼1层", "54"), ("樱荫二巷门牌31 13-4-567", "31"), ("樱荫二巷 11-2-1487", ""),
    ("云栈市樱荫二巷四百二十号院", "420"), ("樱荫Rd甲 180 号（11幢）", "甲180"), ("樱荫二巷18号楼", ""), (None, ""), ("无", ""),
])
def test_doors(address, door):
    assert parse_address(address, "东皋省", "云栈市", "东桥县", "阳沟街道").door == door


def record(i, name, address, lng=116.0, lat=39.0, sysname="s1", district="东桥县", street="阳沟街道", city="云栈市"):
    return (f"SRC_{i:03d}", sysname, "B", None, name, address, "东皋省", city, district, street, lng, lat, None, 1.0, "clash")


def test_address_pairs(spark):
    rows = [record(1, "a", "云栈市樱荫二巷310号"), record(2, "b", "310# 樱阴二Ln, 东桥县, 云栈市 11-2-5"), record(3, "c", "樱荫二巷甲310号"), record(4, "d", "樱荫二巷311号"), record(5, "e", "樱荫二巷310号", district="东岗区"), record(6, "f", None), record(7, "g", "樱荫二巷"),
            record(8, "h", "樱荫大街7号"), record(9, "i", "樱荫街七号", lng=116.0001), record(10, "j", "樱荫街7号", lng=116.3), record(1, "a", "云栈市樱荫二巷310号")]
    got = [tuple(r) for r in addresses.address_pairs(spark.createDataFrame(rows, REC)).collect()]
    assert sorted(got) == [("SRC_001", "SRC_002"), ("SRC_008", "SRC_009"), ("SRC_009", "SRC_010")]
    assert addresses.address_pairs(spark.createDataFrame([], REC)).count() == 0


def test_one_road_for_records_without_location(spark):
    rows = [record(1, "a", "樱荫大街7号"), record(2, "b", "樱荫街7号", lng=116.0001), record(3, "c", "樱荫街7号", lng=None, lat=None), record(4, "d", "樱荫大街9号", lng=116.01), record(5, "e", "樱荫街9号", lng=116.0101), record(6, "f", "樱荫大街9号", lng=116.1),
            record(7, "g", "竹岸大街7号", lng=116.2), record(8, "h", "竹岸街7号", lng=116.3), record(9, "i", "竹岸街7号", lng=None, lat=None)]
    got = sorted(tuple(r) for r in addresses.address_pairs(spark.createDataFrame(rows, REC)).collect())
    pair = lambda a, b: (f"SRC_{a:03d}", f"SRC_{b:03d}")
    assert got == [pair(1, 2), pair(1, 3), pair(2, 3), pair(4, 5), pair(4, 6), pair(5, 6), pair(8, 9)]


def test_alignment():
    assert addresses.align("樱荫|二|巷", "樱荫|二|巷", False) == 0 and addresses.align("樱荫||街", "樱荫||大街", False) == addresses.DICTIONARY
    assert addresses.align("樱荫|二|巷", "樱荫|一|巷", True) >= 1 and addresses.align("樱荫||路", "樱苗||路", True) <= addresses.MAX_COST < addresses.align("樱荫||路", "樱苗||路", False)
    assert addresses.align("樱阴||路", "樱荫||路", False) == addresses.LOOKALIKE and addresses.align("樱荫||路", "樱荫||道", False) == addresses.DICTIONARY
    assert addresses.align("樱荫||大道", "樱荫||道", False) <= addresses.MAX_COST < addresses.align("樱荫|东|路", "樱荫||路", False)  # a gap can pass, a side's cannot


def test_band_recall(spark):
    """Roads of one city with one other character, or another kind, share a band in nine of ten cases or more."""
    bases = [a + b for a in "樱竹柳松桂枫榆槐" for b in "荫岸堤影桥坡风园"]
    rows = [("c", f"{b}||路", 50 if i % 2 else 1) for i, b in enumerate(bases)] + [("c", f"{b}||道", 1) for b in bases]
    n = {r[1]: r[2] for r in rows}
    got = {(r["road_a"], r["road_b"]) for r in addresses.candidate_roads(spark.createDataFrame(rows, "city string, road string, n bigint")).collect()}
    names = [r[1] for r in rows]
    differ = lambda x, y: sum(p != q for p, q in zip(x.replace("|", ""), y.replace("|", ""), strict=True))
    want = {(min(x, y), max(x, y)) for x in names for y in names if x != y and differ(x, y) == 1 and (x[:2] == y[:2] or {n[x], n[y]} == {1, 50})}
    assert len(want & got) / len(want) >= 0.9


def entities():
    return [("COMM_1", "碧映朗大厦E区", "东皋省", "云栈市", "东桥县", "阳沟街道", ["SRC_001", "src_001 "], None), ("COMM_2", "枫和碧小区", "东皋省", "云栈市", "东桥县", "阳沟街道", [], None), ("COMM_3", "枫和碧公寓", "东皋省", "云栈市", "东桥县", "信里街道", None, None), ("COMM_4", None, None, None, None, None, ["SRC_X"], None)]


def test_link_variants(spark):
    rows = [record(1, "碧映朗大厦E区", "樱荫路1号"), record(2, "Biyinglang Dasha Equ", "樱荫路1号"), record(3, "枫和碧", "x", street="阳沟街道"), record(4, "枫枫和碧公寓", None, lng=116.2, street="信里街道"), record(5, "枫和碧公寓", None, lng=116.2, street="信里街道"), record(6, "枫和碧小区二期", None), record(7, "未知", "樱荫路1号"), record(8, None, None), record(9, "完全别的大厦", None)]
    got = sorted(tuple(r) for r in variants.link_variants(spark.createDataFrame(rows, REC), spark.createDataFrame(entities(), ENT)).collect())
    assert got == [("COMM_1", "SRC_002"), ("COMM_2", "SRC_003"), ("COMM_3", "SRC_004")]
    assert variants.link_variants(spark.createDataFrame([], REC), spark.createDataFrame(entities(), ENT)).count() == 0
    assert variants.link_variants(spark.createDataFrame(rows, REC), spark.createDataFrame([], ENT)).count() == 0


def test_match_records(spark):
    rng = random.Random(3)
    cores = [a + b for a in "溪湖岚汇曦和铂润" for b in "紫麓榕青秀瑞渡棠"]
    rows, truth, i = [], set(), 0
    for p, core in enumerate(cores):
        x, y, ids = 116 + rng.random() / 10, 39 + rng.random() / 10, []
        for k, s in enumerate(("s1", "s2", "s3")):
            i += 1
            name = rng.choice([core + "大厦", core, core + "大厦"])
            rows.append(record(i, name, rng.choice([f"樱荫路{p + 1}号", None, f"樱荫路门牌{p + 1}"]), x + rng.random() / 1e4, y, s))
            ids.append(f"SRC_{i:03d}")
        truth |= {(a, b) for a in ids for b in ids if a < b}
    ents = spark.createDataFrame([("COMM_1", "x", None, None, None, None, ["SRC_001", "SRC_002"], None)], ENT)
    got = matching.match_records(spark.createDataFrame(rows, REC), ents).collect()
    found = {(r["record_id_a"], r["record_id_b"]) for r in got}
    truth.discard(("SRC_001", "SRC_002"))  # both are listed
    assert len(found) == len(got) and len(found & truth) / len(truth) > 0.9 and len(found & truth) / len(found) > 0.95 and all(0.5 <= r["confidence"] <= 1 for r in got)
    assert matching.match_records(spark.createDataFrame([], REC), ents).count() == 0


def test_pairs_that_cannot_match_are_not_written(spark, monkeypatch):
    """Pairs are counted by vector and only those that may match are written; which of them are written at once changes no row."""
    rng = random.Random(4)
    rows = [record(i, rng.choice("溪湖岚汇曦和") + rng.choice("紫麓榕青秀瑞") + rng.choice(["大厦", "公寓", ""]), rng.choice([None, f"樱荫路{rng.randint(1, 20)}号"]), 116 + rng.random() / 100, 39 + rng.random() / 100, f"s{i % 3}") for i in range(240)]
    args = spark.createDataFrame(rows, REC), spark.createDataFrame([("COMM_1", "x", None, None, None, None, ["SRC_001", "SRC_002"], None)], ENT)
    sizes, cut = {}, matching.Cut

    def counted(df, name):
        out = cut(df, name)
        sizes.setdefault(name, out.df.where("rid_a is not null").count() if name == "candidates" else 0)
        return out

    monkeypatch.setattr(matching, "Cut", counted)
    got = []
    for least in (0.0, 9.0):
        sizes.clear()
        monkeypatch.setattr(matching, "LIKELY", least)
        got.append(({tuple(r)[:2] for r in matching.match_records(*args).collect()}, sizes["candidates"]))
    (all_rows, all_pairs), (rows_, pairs_) = got
    assert all_rows == rows_ and all_rows and all_pairs > 1000 and pairs_ == 0 and "met" not in sizes


def test_candidates_by_location_and_city(spark):
    from cadastra.llm.places import syllable_mask

    cols = "n bigint, rid string, sys string, listed boolean, x double, y double, bx double, by double, kind string, bag string, parts string, ends string, city string, district string, office string, road string, door string, mask bigint"
    row = lambda i, sysname, bag, x, y, district="d", parts="", door="", city="c", bx=None: (i, f"R{i:02d}", sysname, False, x, y, bx, y if bx else None, "E" if bag else "", bag, parts, "", city, district, "", "r||路" if door else "", door, syllable_mask(bag))
    rows = [row(1, "s1", "han yi", 116.0, 39.0), row(2, "s2", "", 116.0001, 39.0), row(3, "s2", "", 116.003, 39.0),  # a blank twin 10 m away; one 260 m away
            row(4, "s1", "tang wang wu", 116.1, 39.0), row(5, "s2", "tang wang yu", 116.1001, 39.0), row(6, "s2", "tang wang yu", 116.1001, 39.0, parts="p2"),  # a misspelt name; another phase
            row(7, "s1", "lan", 116.2, 39.0), row(8, "s2", "lan", None, None, district=""), row(9, "s2", "mei hua", 116.9, 39.0, district="", door="7"), row(10, "s1", "mei hui", 116.3, 39.0, door="7"),  # unknown district: by name, by door
            row(14, "s1", "", 117.0, 39.0, bx=116.6), *[row(15 + k, "s2", f"bag {k}" * 5, 117.0, 39.0) for k in range(3)], row(18, "s2", "gui", 116.6001, 39.0)]  # a default point; the polygon stays
    table = matching.Cut(spark.createDataFrame(rows, cols), "test").df
    got = sorted((min(r["n_a"], r["n_b"]), max(r["n_a"], r["n_b"])) for r in matching.candidates(table).collect())
    assert got == [(1, 2), (4, 5), (7, 8), (9, 10), (14, 18)]


def test_candidates_by_name_alone(spark):
    """Misspelt names without door and location meet within the district, listed ones only from the other side."""
    from cadastra.llm.grams import BUCKETS

    row = lambda n, sysname, core, sound, listed=False, parts="", district="d": (n, sysname, listed, "E", core, sound, "E", "c", district, parts)
    rows = [row(1, "s1", "汉益堂", "han yi tang"), row(2, "s2", "汉益糖", "han yi tang"), row(3, "s2", "汉亿旺", "han yi wang", True), row(4, "s2", "梅花", "mei hua"), row(5, "s2", "汉益堂", "han yi tang", parts="p2"), row(6, "s3", "汉益庭", "han yi ting", district="")]
    table = matching.Cut(spark.createDataFrame(rows, "n bigint, sys string, listed boolean, kind string, core string, sound string, ends string, city string, district string, parts string"), "test").df
    got = {(r["n_a"], r["n_b"]) for r in matching.name_candidates(table, np.ones(BUCKETS)).collect()}
    assert {(1, 2), (1, 3), (1, 6), (2, 6), (6, 3)} <= got and not any(5 in p or p in ((3, 1), (2, 3)) for p in got)


def test_mixture_separates():
    rng = np.random.default_rng(1)
    x = np.vstack((rng.choice([0.8, 1.0], (40, 5)), rng.choice([0.0, 0.3], (60, 5))))
    x[0, 1] = x[50, 2] = np.nan
    _, p = matching.fit_mixture(x, np.ones(100))
    assert (p[:40] > 0.9).all() and (p[40:] < 0.1).all()
    assert (matching.fit_mixture(x, np.ones(100), np.full(100, 0.6))[1] >= 0.6).all() and (matching.fit_mixture(x, np.ones(100), None, None, np.full(100, 0.4))[1] <= 0.4).all()


def test_transitivity_changes_rows(spark):
    """A chain of two strong matches lifts an unsure pair; of two places that a record without a name fits, one stays."""
    rng = random.Random(5)
    rows = []
    for k in range(300):
        rows.append((f"a{k}", f"b{k}", 1, 1, *(rng.choice((48, 50)), rng.choice((45, 50)), 1, 2, 1, 1)))
        rows.append((f"a{k}", f"z{k}", 1, 2, *(rng.choice((0, 10)), rng.choice((0, 5)), 0, 0, 0, 0)))
    rows += [("p", "q", 1, 1, 50, 50, 1, 2, 1, 1), ("q", "r", 1, 1, 50, 50, 1, 2, 1, 1), ("p", "r", 1, 1, 27, 25, 1, 1, 0, -1)]
    rows += [("u", "v", 0, 3, -1, 50, -1, 2, 1, 1), ("u", "w", 0, 4, -1, 40, -1, 2, 1, 1)]
    df = spark.createDataFrame(rows, "rid_a string, rid_b string, place_a int, place_b int, " + ", ".join(f"{k} byte" for k in matching.DIMS)).select("rid_a", "rid_b", "place_a", "place_b", *[F.col(k).cast("byte") for k in matching.DIMS])
    table = matching.Cut(df, "pairs").df
    of = lambda t: {(r["rid_a"], r["rid_b"]): r["p"] for r in matching.posteriors(table, t).collect() if r["p"] >= matching.MATCH}
    free, held = of(False), of(True)
    assert ("u", "w") in free and ("u", "w") not in held and ("u", "v") in held and ("p", "q") in held
    assert free.get(("p", "r"), 0.0) <= held.get(("p", "r"), 0.0) and set(free) != set(held)


def test_misspelt_name_alone(spark):
    """A misspelt name without address and location reaches the threshold, so it is a candidate and linked."""
    rows = [record(1, "碧映朗庭大厦", None), record(2, "碧映郎廷大夏", None), record(3, "碧映朗岚大厦", None)]
    ents = [("COMM_1", "碧映朗庭大厦", "东皋省", "云栈市", "东桥县", "阳沟街道", None, None), ("COMM_2", "枫和碧公寓", "东皋省", "云栈市", "东桥县", "信里街道", None, None), *[(f"COMM_{k}", n, "东皋省", "云栈市", "东桥县", "信里街道", None, None) for k, n in enumerate("溪湖苑 曦和府 铂润园 棠瑞里".split(), 3)]]
    got = {tuple(r) for r in variants.link_variants(spark.createDataFrame(rows, REC), spark.createDataFrame(ents, ENT)).collect()}
    assert ("COMM_1", "SRC_003") in got


def test_prefixes_lose_no_pair():
    """Of random mentions, every pair at the threshold shares a term of the beginnings of both."""
    from cadastra.llm import grams

    rng = random.Random(8)
    table = np.random.default_rng(8).uniform(0.5, 9, grams.BUCKETS)
    sounds = "han yi tang wang wu lan mei hua".split()
    mentions = []
    for _ in range(250):
        y = rng.sample(sounds, rng.randint(2, 3))
        name = ("".join(chr(0x4E00 + sounds.index(k)) for k in y), " ".join(y), rng.choice(["", "E", "F"]))
        at = rng.choice([("c", "", "", "", None, None), ("c", rng.choice("op"), rng.choice(["r", "s", ""]), rng.choice(["", "7"]), *rng.choice([(None, None), (116 + rng.random() / 300, 39.0)]))])
        mentions.append((*name, *at))
    begin = [set(grams.prefix_terms(m, table, variants.BESIDE, variants.THRESHOLD)) for m in mentions]
    l, r = zip(*[(i, k) for i in range(250) for k in range(i)], strict=True)  # noqa: E741
    cos = [grams.cosines([mentions[i][lo:hi] for i in l], [mentions[i][lo:hi] for i in r], lambda *f: grams.unit(terms(*f), idf)) for lo, hi, terms, idf in ((0, 3, grams.name_terms, table), (3, 9, grams.address_terms, None))]
    sims = np.where(np.isnan(cos[1]), (1 - variants.BESIDE) ** 0.5 * cos[0], (1 - variants.BESIDE) * cos[0] + variants.BESIDE * cos[1])
    hit = sims >= variants.THRESHOLD
    assert hit.sum() > 500 and all(begin[i] & begin[k] for i, k, h in zip(l, r, hit, strict=True) if h)


def test_first_shared_terms_reach_the_threshold():
    """Two names of the least cosine or more reach it by the first term that they share; fewer of the others do."""
    from cadastra.llm import grams

    rng, table, least = random.Random(3), np.random.default_rng(3).uniform(0.5, 9, grams.BUCKETS), 0.5
    sounds = "han yi tang wang wu lan mei hua".split()
    forms = [("".join(chr(0x4E00 + sounds.index(k)) for k in y), " ".join(y), rng.choice(["", "E", "F"])) for y in (rng.sample(sounds, rng.randint(2, 4)) for _ in range(150))]
    begin = [{t: (w, r) for t, w, r in grams.prefix_weights(f, table, None, least)} for f in forms]
    l, r = zip(*[(i, k) for i in range(150) for k in range(i)], strict=True)  # noqa: E741
    cos = grams.cosines([forms[i] for i in l], [forms[i] for i in r], lambda *f: grams.unit(grams.name_terms(*f), table))
    meets = np.array([any(begin[i][t][0] * begin[k][t][0] + begin[i][t][1] * begin[k][t][1] >= least * grams.STEPS**2 for t in begin[i].keys() & begin[k].keys()) for i, k in zip(l, r, strict=True)])
    shares = np.array([bool(begin[i].keys() & begin[k].keys()) for i, k in zip(l, r, strict=True)])
    assert (cos >= least).sum() > 300 and meets[cos >= least].all() and meets.sum() < 0.9 * shares.sum()


def test_a_cut_leaves_no_shuffle_behind(spark):
    from cadastra import runtime


    def shuffles() -> list[str]:
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return [f for f in (str(files.apply(i)) for i in range(files.size())) if "shuffle_" in f]

    was, before = spark.conf.get(runtime.CLEANUP, None), set(shuffles())
    d = runtime.Cut(spark.range(1000).repartition(3, "id"), "t").df
    for _ in range(50):  # files go in the background
        if not (left := set(shuffles()) - before):
            break
        time.sleep(0.1)
    assert not left and d.count() == 1000 and spark.conf.get(runtime.CLEANUP, None) == was


def test_average_linkage(spark):
    """Fixed groups stay apart, equally near ones are joined by nothing, pairs join each other."""
    edge = lambda a, b, s, m=1: (a, b, s, 1, m)
    rows = [edge("x1", "=E3", 1.8, 2), edge("x1", "=E2", 0.9, 2), edge("x2", "x1", 0.9), edge("x1", "x2", 0.9), edge("x3", "=E1", 0.7), edge("x3", "=E2", 0.7), edge("x4", "x5", 0.8), edge("x5", "x4", 0.8), edge("x6", "=E2", 0.2)]
    got = {r["a"]: r["root"] for r in variants.average_linkage(spark.createDataFrame(rows, "a string, b string, sum double, n int, m int"), variants.THRESHOLD).collect()}
    assert got["x1"] == "=E3" and "x3" not in got and "x6" not in got and got.get("x5") == "x4" and not got.get("x4", "").startswith("=")


def test_threshold_decides(spark, monkeypatch):
    rows = [record(1, "碧映朗大厦E区", "樱荫路1号"), record(2, "碧映大厦E区", "樱荫路1号"), record(3, "碧映朗大厦E区物业", "樱荫路1号")]
    run = lambda: {tuple(r) for r in variants.link_variants(spark.createDataFrame(rows, REC), spark.createDataFrame(entities(), ENT)).collect()}
    monkeypatch.setattr(variants, "SURE", 0.99)
    monkeypatch.setattr(variants, "THRESHOLD", 0.999)
    assert not run()
    monkeypatch.setattr(variants, "THRESHOLD", 0.5)
    assert ("COMM_1", "SRC_002") in run()


def test_cosines_against_loops():
    from cadastra.llm import grams

    rng, w = random.Random(2), np.linspace(1, 5, grams.BUCKETS)
    names = [("".join(rng.choices("溪湖岚汇曦", k=rng.randint(0, 3))), " ".join(rng.choices(["xi", "hu", "lan"], k=rng.randint(0, 3))), rng.choice(["", "府", "嘉园|家园"])) for _ in range(30)]
    vector = lambda *f: grams.unit(grams.name_terms(*f), w)
    pairs_ = [(a, b) for a in names for b in names]
    got = grams.cosines([a for a, _ in pairs_], [b for _, b in pairs_], vector)
    for (a, b), g in zip(pairs_, got, strict=True):
        u, v = (dict(zip(*(x.tolist() for x in vector(*f)), strict=True)) for f in (a, b))
        assert (np.isnan(g) and (not u or not v)) or abs(g - sum(x * v.get(t, 0) for t, x in u.items())) < 1e-9


@pytest.fixture(scope="module")
def vocabulary():
    import os

    p = tokens.default_vocabulary()
    if not os.path.exists(p):
        pytest.skip("no vocabulary here")
    return p


def test_tokens_like_library(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    texts = ["", "a", "aaaaaaaaaaaaa", " \n\n  x's don't we'll", "龍契士覚醒ードン한국어", "<|endoftext|> x", "🏠👷🏽‍♀️ é naïve ﬁ", "0123456789" * 20, "\u0000﻿​", "ab" * 5000, "经核实，慢性病属实。Overall, 3.14 – “q”"]
    rng = random.Random(9)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0xA0, 0x2FF), 10, 32])) for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    flat, n = tokens.Encoder.of(vocabulary).texts(texts)
    ends = np.cumsum(n)
    assert [flat[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encode_rows(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_CHARS", 10)
    df = spark.createDataFrame([(1, "hello", "x"), (2, None, "x"), (3, "", "x"), (1, "hello", "x"), (4, "世界" * 50, "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], len(r["ids"])) for r in tokens.encode(df, vocabulary).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and got[2][1] == got[3][1] == 0 and got[4][1] > 0
    assert tokens.encode(df.limit(0), vocabulary).count() == 0
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, ["doc_id"], vocabulary).collect()}
    assert n[2] == 0 and n[4] == got[4][1]


def test_mix(spark, vocabulary):
    docs = [(i, f"text number {i} of a big source", "Big ") for i in range(300)] + [(1000 + i, f"small one {i}", "small") for i in range(10)] + [(2000 + i, "small one 0", "small") for i in range(5)] + [(3000, None, "big"), (3001, "no source text number", None)]
    plans = [("p", "big", 0.5, 2, 1.0), ("p", "small", 0.5, 3, 1.0), ("p", "gone", 0.0, 2, 1.0), ("q", "big", 0.9, 2, 0.5), ("q", "gone", 0.1, 2, 0.5)]
    got = {(r["mix_id"], r["source"]): r for r in mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(plans, "mix_id string, source string, target_share double, max_repeats int, total_ratio double"), vocabulary).collect()}
    assert got["p", "small"]["texts"] == 10 and abs(got["p", "small"]["mean_repeats"] - 3) < 0.05 and not got["p", "small"]["reached"]
    assert got["p", "big"]["reached"] and abs(got["p", "big"]["used_tokens"] / got["p", "big"]["wanted_tokens"] - 1) < 0.15
    assert got["p", "gone"]["reached"] and got["p", "gone"]["used_tokens"] == 0 and not got["q", "gone"]["reached"]
    assert abs(sum(r["actual_share"] for k, r in got.items() if k[0] == "p") - 1) < 1e-4


def test_mix_least_squares(spark, vocabulary, monkeypatch):
    """Texts that are half of each source can't give one of them its target without the other getting as much: half of it is nearest to both targets."""
    monkeypatch.setattr(mixing, "posteriors", lambda texts, docs, names: texts.select("src", "key", "n_tokens", "copies", F.array(F.lit(0.5), F.lit(0.5)).alias("pi")))
    docs = spark.createDataFrame([(i, f"text number {i}", None) for i in range(400)], "doc_id bigint, text string, source string")
    plans = spark.createDataFrame([("p", "a", 1.0, 9, 1.0), ("p", "b", 0.0, 9, 1.0), ("q", "a", 0.5, 9, 1.0), ("q", "b", 0.5, 9, 1.0)], "mix_id string, source string, target_share double, max_repeats int, total_ratio double")
    got = {(r["mix_id"], r["source"]): r["used_tokens"] / (r["source_tokens"] * 2) for r in mixing.mix(docs, plans, vocabulary).collect()}
    assert abs(got["p", "a"] - 0.5) < 0.05 and abs(got["p", "b"] - 0.5) < 0.05
    assert abs(got["q", "a"] - 0.5) < 0.05


def subject_texts(n, seed):
    rng = random.Random(seed)
    words = {"law": "court appeal title permit zoning plot".split(), "sport": "match goal league coach referee final".split(), "health": "clinic dose nurse fever scan patient".split()}
    fill = ["Nothing was left out.", "See the note below.", "Received today."]
    texts, labels = [], []
    for _ in range(n):
        ls = rng.sample(list(words), rng.choice([1, 1, 2]))
        sents = [f"The {rng.choice(words[k])} and the {rng.choice(words[k])} came first." for k in ls for _ in range(4)] + rng.sample(fill, 2)
        rng.shuffle(sents)
        texts.append(" ".join(sents))
        labels.append(set(ls))
    return texts, labels


def test_subjects_held_out():
    texts, labels = subject_texts(300, 1)
    labels[:10] = [{"law"}] * 10  # a few are wrong
    names = ["health", "law", "sport"]
    m = subjects.train(texts, labels, names)
    held, truth = subject_texts(100, 2)
    x = subjects.sentences(held)
    got = subjects.shares(x, subjects._scores(x, m.w, m.bias), 100) >= m.thresholds
    want = np.array([[k in t for k in names] for t in truth])
    assert (got == want).mean() > 0.97


def test_classify_rows(spark):
    texts, labels = subject_texts(120, 3)
    docs = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, "🏠🏠", "x")]
    lab = [(i, k) for i in range(90) for k in sorted(labels[i])] + [(0, next(iter(labels[0]))), (None, "law"), (5, None), (777, "law")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject_code string")
    la, su = spark.createDataFrame(lab, "doc_id bigint, subject_code string"), spark.createDataFrame([(k, "") for k in ("health", "law", "sport")], "subject_code string, about string")
    got = subjects.classify(d, la, su).collect()
    want = {(i, k) for i in range(90, 120) for k in labels[i]}
    found = {tuple(r) for r in got}
    assert len(got) == len(found) and len(found & want) >= 0.9 * len(want) and len(found - want) <= 3 and not {r[0] for r in found} & {900, 901, 902}
    assert subjects.classify(d, la.limit(0), su).count() == 0 and subjects.classify(d.limit(0), la, su).count() == 0


def test_fold():
    assert fold("ＡＢ號​１") == "ab号1"
