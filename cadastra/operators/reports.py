"""Reports of a run: goals, summaries, confusions, checks of layers and data sets, enrichment by known names, bench cases and gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_blank, norm_id

#: Experiments of the benchmark matrix, and the cases taken and kept in reserve of each morphology.
EXPERIMENTS = ("B0", "B1", "B2", "B3-OSM", "B3-OVERTURE", "B3-MICROSOFT", "B4-OSM", "B4-OVERTURE", "B4-MICROSOFT", "B5", "B6", "B7")
TAKEN, RESERVE = 5, 2


def problem_priority(decision: Column, coord: Column, issues: Column) -> Column:
    """Goal A: HARD for fences to warn of or review, or with mixed coordinates, FLAGGED for others with an issue; null for sound ones."""
    hard = F.coalesce(decision.isin("WARN", "REVIEW"), F.lit(False)) | F.coalesce(coord == "MIXED_CRS", F.lit(False))
    return F.when(hard, "HARD").when(F.size(issues) > 0, "FLAGGED")


def both_goals(problems: DataFrame, key: str, relations: DataFrame) -> DataFrame:
    """The rows of `problems` whose key is an end of a relation with an overlap (goals A and B)."""
    over = relations.where("iou > 0 AND NOT isnan(iou)")
    ends = over.select(F.explode(F.array(norm_id(F.col("subject_record_id")), norm_id(F.col("object_record_id")))).alias(key)).distinct()
    return problems.join(ends, key, "left_semi")


def pipeline_summary(records: DataFrame, relations: DataFrame, entities: DataFrame, versions: DataFrame) -> DataFrame:
    """One row of counters; four aggregates of one row each are put side by side."""
    soft = F.col("relation_type") == "RELATED_ENTITY"
    ce = F.when(~F.isnan("cross_encoder_score"), F.col("cross_encoder_score"))
    rel = relations.agg(F.count(F.lit(1)).alias("total_relations"), F.countDistinct("relation_type").alias("kinds"), F.count_if(soft).alias("soft_pairs"), F.count_if(soft & (ce < 0.3)).alias("downgraded"), F.count_if(soft & (ce >= 0.85)).alias("alias_confirmed"))
    ent = entities.agg(F.countDistinct("canonical_entity_id").alias("entities"), F.countDistinct(F.when(F.coalesce("member_count", F.lit(1)) > 1, F.col("canonical_entity_id"))).alias("merged_clusters"))
    one = [rel, records.agg(F.count(F.lit(1)).alias("total_records")), ent, versions.agg(F.countDistinct("geometry_version_id").alias("geometry_versions"))]
    out = one[0].withColumn("_", F.lit(1))
    for x in one[1:]:
        out = out.join(x.withColumn("_", F.lit(1)), "_")
    return out.drop("_")


def mic_class(radius: Column) -> Column:
    """Class of a shape by the radius of its largest circle, in m."""
    return F.when(radius < 12.5, "THIN").when(radius < 25, "NARROW").otherwise("WIDE")


def confusion(rows: DataFrame, group: str, flag: str, truth: str) -> DataFrame:
    """(group, n, true_positive, false_positive, missed) of a rule's flag against the truth; null flags and truths are false."""
    f, t = (F.coalesce(F.col(c), F.lit(False)) for c in (flag, truth))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(f & t).alias("true_positive"), F.count_if(f & ~t).alias("false_positive"), F.count_if(~f & t).alias("missed"))


def layer_checks(faces: DataFrame) -> DataFrame:
    """(check, value, status) of a layer on arrival: null names, empty geometries, repeated rows, layers."""
    whole = faces.groupBy(*faces.columns).agg(F.count(F.lit(1)).alias("copies"))
    a = whole.agg(F.count_if(F.col("name").isNull()).alias("null_names"), F.count_if(F.col("geometry_wkt").isNull() | (F.trim("geometry_wkt") == "")).alias("null_geometry"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated_rows"), F.countDistinct("source_layer").alias("layers"))
    row = lambda k, bad, word: F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), F.when(bad(F.col(k)), word).otherwise("PASS").alias("status"))
    rows = [row("null_names", lambda v: v > 0, "WARN"), row("null_geometry", lambda v: v > 0, "FAIL"), row("repeated_rows", lambda v: v > 0, "WARN"), row("layers", lambda v: v == 0, "FAIL")]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def readiness(records: DataFrame, dataset: str, key: str, load: str) -> DataFrame:
    """(dataset, rows, keyed, several_loads, ready): whether a data set is there, keyed throughout and delivered twice or more."""
    keyed = F.min(F.when(F.col(key).isNull() | (F.trim(key) == ""), 0).otherwise(1)) == 1
    a = records.groupBy(F.col(dataset).alias("dataset")).agg(F.count(F.lit(1)).alias("rows"), keyed.alias("keyed"), (F.countDistinct(load) >= 2).alias("several_loads"))
    return a.withColumn("ready", (F.col("rows") > 0) & F.col("keyed") & F.col("several_loads"))


def enrich(rows: DataFrame, key: str, name: str, known: DataFrame, source: str, prefix: str) -> DataFrame:
    """(key, source, how): the known name that a row's name is or begins with (the smallest source on ties).

    A name meets the prefixes of the lengths that occur, so the join is by equality; null names meet nothing."""
    lengths = [r[0] for r in known.select(F.length(prefix).alias("n")).where("n > 0").distinct().collect()]  # as many as known names have lengths
    if not lengths:
        return rows.select(key, F.lit(None).cast("bigint").alias(source), F.lit("").alias("how")).limit(0)
    heads = rows.where(F.col(name).isNotNull()).select(key, name, F.explode(F.array(*[F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in sorted(lengths)])).alias(prefix)).where(F.col(prefix).isNotNull())
    j = heads.join(known.select(source, prefix), prefix)
    return j.groupBy(key).agg(F.min(source).alias(source), F.when(F.bool_or(F.col(prefix) == F.col(name)), "EXACT").otherwise("PREFIX").alias("how"))


# ---- benchmark and gold

def select_cases(pool: DataFrame, stratum: str, order: Column) -> DataFrame:
    """The pool with `case_id` and `reserve`: of each stratum the first TAKEN by a deterministic order, then RESERVE more; the
    selection is a sample by design. Case numbers run over the strata in their order."""
    w = Window.partitionBy(stratum).orderBy(order)
    p = pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= TAKEN + RESERVE)
    strata = p.select(stratum).distinct().withColumn("at", F.row_number().over(Window.orderBy(stratum)))  # strata are few
    p = p.join(strata, stratum).withColumn("reserve", F.col("rn") > TAKEN)
    number = F.when(F.col("reserve"), (F.col("at") - 1) * RESERVE + F.col("rn") - TAKEN).otherwise((F.col("at") - 1) * TAKEN + F.col("rn"))
    return p.withColumn("case_id", F.format_string("%s-%04d", F.when(F.col("reserve"), "RES").otherwise("CASE"), number)).drop("rn", "at")


def blind_review(cases: DataFrame, answers: list[str]) -> DataFrame:
    """`cases` with `approved` (all answers are true; null ones are not) and `failed`, the first question that is not."""
    ok = [F.coalesce(F.col(a), F.lit(False)) for a in answers]
    all_ = F.lit(True)
    for o in ok:
        all_ = all_ & o
    first = F.coalesce(*[F.when(~o, F.lit(a)) for a, o in zip(answers, ok, strict=True)], F.lit(None).cast("string"))
    return cases.withColumn("approved", all_).withColumn("failed", first)


def run_matrix(cases: DataFrame, proposals: DataFrame) -> DataFrame:
    """(case_id, experiment_id, candidates, top_id, top_score) of each case and experiment: `proposals` (case_id, provider, hypothesis_id,
    score) of the providers an experiment uses. Experiments without a proposal have 0 candidates. Each case meets the fixed
    list of experiments; proposals meet theirs by provider."""
    uses = {"B0": ["AREA_PRIOR"], "B1": ["EXISTING"], "B2": ["ROAD_BLOCK"], "B5": ["CLUSTER_MULTI"], "B6": ["CLUSTER_MULTI", "ROAD_BLOCK", "EXISTING"], "B7": ["CLUSTER_MULTI", "ROAD_BLOCK", "EXISTING"]}
    for s in ("OSM", "OVERTURE", "MICROSOFT"):
        uses |= {f"B3-{s}": [f"CLUSTER_{s}"], f"B4-{s}": [f"CLUSTER_{s}", "ROAD_BLOCK"]}
    by: dict[str, list[str]] = {}
    for e, ps in uses.items():
        for p in ps:
            by.setdefault(p, []).append(e)
    which = F.create_map(*[x for p, es in by.items() for x in (F.lit(p), F.array(*map(F.lit, es)))])
    p = proposals.withColumn("experiment_id", F.explode(which[F.col("provider")]))
    got = p.groupBy("case_id", "experiment_id").agg(F.count(F.lit(1)).alias("candidates"), F.max_by("hypothesis_id", F.struct("score", "hypothesis_id")).alias("top_id"), F.max("score").alias("top_score"))
    grid = cases.select("case_id", F.explode(F.array(*map(F.lit, EXPERIMENTS))).alias("experiment_id"))
    return grid.join(got, ["case_id", "experiment_id"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def freeze_gold(reviews: DataFrame) -> DataFrame:
    """(case_id, gold_state, boundaries, conflicts, content_hash) of reviews (case_id, reviewer, entity_sufficient, boundary_sufficient, conflict):
    resolved where entity and boundary suffice for all reviewers and none conflicts, partial where the entity does, else
    unresolved. The hash is of the content, in the order of reviewers; clocks take no part."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    line = F.concat_ws("|", "reviewer", yes("entity_sufficient").cast("string"), yes("boundary_sufficient").cast("string"), yes("conflict").cast("string"))
    g = reviews.groupBy("case_id").agg(F.min(yes("entity_sufficient").cast("int")).alias("e"), F.min(yes("boundary_sufficient").cast("int")).alias("b"), F.count_if(yes("boundary_sufficient")).alias("boundaries"), F.count_if(yes("conflict")).alias("conflicts"),
                                       F.sha2(F.concat_ws(";", F.sort_array(F.collect_list(line))), 256).alias("content_hash"))  # a case has few reviewers
    state = F.when((F.col("e") == 1) & (F.col("b") == 1) & (F.col("conflicts") == 0), "GOLD_RESOLVED").when(F.col("e") == 1, "GOLD_PARTIAL").otherwise("GOLD_UNRESOLVED")
    return g.select("case_id", state.alias("gold_state"), "boundaries", "conflicts", F.substring("content_hash", 1, 16).alias("content_hash"))


def ceiling_report(gold: DataFrame, group: str) -> DataFrame:
    """(group, cases, resolved, partial, unresolved, resolved_share) of the gold states."""
    is_ = lambda s: F.count_if(F.col("gold_state") == s)
    return gold.groupBy(group).agg(F.count(F.lit(1)).alias("cases"), is_("GOLD_RESOLVED").alias("resolved"), is_("GOLD_PARTIAL").alias("partial"), is_("GOLD_UNRESOLVED").alias("unresolved"), F.round(F.avg((F.col("gold_state") == "GOLD_RESOLVED").cast("int")), 6).alias("resolved_share"))


def locked_subset(answers: DataFrame, locked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(mean score of the locked subset, keys of it without an answer): a run counts only where the second is empty."""
    mine = answers.join(locked.select(key).distinct(), key, "left_semi")
    return mine.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")), locked.select(key).distinct().join(answers, key, "left_anti")


def city_faces(layers: DataFrame, land: Column, poi: Column, keep: tuple[str, ...], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """`layers` (layer, fclass, lng, lat, ...) with `code` and `src_layer`: land use always, points of interest where mapped, transport
    of the kept kinds; within `box` (least latitude, least longitude, most, most) by the representative point, if given."""
    inside = F.lit(True) if box is None else F.col("lat").between(box[0], box[2]) & F.col("lng").between(box[1], box[3])
    code = F.when(F.col("layer") == "landuse", F.coalesce(land, F.lit("U"))).when(F.col("layer") == "poi", poi).when((F.col("layer") == "transport") & F.col("fclass").isin(*keep), "S")
    name = F.when(F.col("layer") == "poi", "poi_area").otherwise(F.col("layer"))
    return layers.where(F.coalesce(inside, F.lit(False))).withColumns({"code": code, "src_layer": name}).where("code IS NOT NULL")


def health(records: DataFrame) -> DataFrame:
    """One row: completeness, zero points and groups of repeats (by city and name, by point to six decimals, by polygon text)."""
    c = F.col
    none = lambda k: c(k).isNull() | (c(k) == "")
    rate = lambda t, k: F.round(F.avg(t.cast("int")), 6).alias(k)
    lost = lambda k: c(k).isNull() | F.isnan(k)
    base = records.agg(F.count(F.lit(1)).alias("total"), rate(none("name_raw"), "name_null_rate"), rate(none("address_raw"), "address_null_rate"), rate(lost("point_raw_lng") | lost("point_raw_lat"), "point_null_rate"), F.count_if((c("point_raw_lng") == 0) | (c("point_raw_lat") == 0)).alias("zero_points"),
                       rate(none("geometry_raw_wkt"), "geometry_null_rate"), rate(none("city_raw") | none("district_raw"), "admin_null_rate"))

    def repeats(d: DataFrame, keys: list[Column], names: list[str]) -> DataFrame:
        g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return g.agg(*[(F.count(F.lit(1)) if k.endswith("groups") else F.coalesce(F.sum("n"), F.lit(0))).alias(k) for k in names])

    sides = [repeats(records, [c("city_raw"), c("name_raw")], ["name_groups", "name_records"]), repeats(records.where(~lost("point_raw_lng") & ~lost("point_raw_lat")), [F.round("point_raw_lng", 6) + 0.0, F.round("point_raw_lat", 6) + 0.0], ["point_groups"]), repeats(records.where("geometry_raw_wkt <> ''"), [c("geometry_raw_wkt")], ["wkt_groups"])]
    out = base.withColumn("_", F.lit(1))
    for x in sides:
        out = out.join(x.withColumn("_", F.lit(1)), "_")
    return out.drop("_")


def blank_share(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of blank values of each column."""
    return rows.agg(*[F.round(F.avg(is_blank(F.col(c)).cast("int")), 6).alias(c) for c in columns])
