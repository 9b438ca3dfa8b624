"""Views derived by plain arithmetic from the star-schema tables, in Spark and in SQL alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

TABLES = ("customer", "nation", "supplier", "part", "orders", "lineitem", "events", "source_records", "entity_relations")
#: SQL of the views; every number is a double so that both engines agree.
FENCES_SQL = """fences AS (
  SELECT c_custkey AS id, n_name AS city, c_mktsegment AS district, c_name AS name, c_acctbal AS bal,
    CAST(116.0 AS DOUBLE) + CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 2000 AS lng, CAST(39.6 AS DOUBLE) + CAST((c_custkey * 104729) % 1000 AS DOUBLE) / 2000 AS lat,
    CAST(20 + (c_custkey * 31) % 400 AS DOUBLE) AS width_m, CAST(15 + (c_custkey * 17) % 300 AS DOUBLE) AS height_m
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
boxes AS (SELECT *, lng - width_m / 170000 AS x0, lng + width_m / 170000 AS x1, lat - height_m / 222000 AS y0, lat + height_m / 222000 AS y1 FROM fences)"""

LEDGER_SQL = """ledger AS (
  SELECT user_id AS entity_id, event_id AS seq, event_id AS evidence_id, CASE WHEN event_type = 'error' AND value > 80 THEN 'REFUTING' ELSE 'SUPPORTING' END AS kind,
    CASE WHEN event_type IN ('view', 'click') THEN 'GEOMETRY' WHEN event_type = 'purchase' THEN 'AUDIT' ELSE 'FINDING' END AS category,
    CASE WHEN event_id % 7 = 3 THEN event_id - 3 END AS gone FROM events)"""

RUNS_SQL = """runs AS (
  SELECT l_orderkey AS case_id, 'B' || CAST(l_linenumber AS VARCHAR) AS experiment_id, CAST(CAST(l_quantity AS BIGINT) % 5 AS BIGINT) AS candidate_count,
    CAST(l_discount AS DOUBLE) * 8 AS top1_iou, CAST(l_discount AS DOUBLE) * 8 + CAST(l_tax AS DOUBLE) * 4 AS oracle_iou,
    CASE l_returnflag WHEN 'A' THEN 'TRUSTED' WHEN 'N' THEN 'UNRESOLVED' ELSE 'REJECTED' END AS disposition FROM lineitem)"""

PRED_SQL = """pred AS (SELECT o_orderkey AS id, CAST((o_orderkey * 37) % 1001 AS DOUBLE) / 1000 AS confidence, (o_orderkey * 13) % 1000 < (o_orderkey * 37) % 1001 AS correct FROM orders)"""


def inputs(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The rows of a text that both engines read, over the tables that it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(sql.replace("AS VARCHAR)", "AS STRING)"))


def fences(spark: SparkSession, d: str) -> DataFrame:
    """Axis-aligned fences of customers: id, city, district, name, centre, sizes in metres and box in degrees."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    k = F.col("c_custkey")
    f = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"), F.col("n_name").alias("city"), F.col("c_mktsegment").alias("district"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"),
        (F.lit(116.0) + (k * 7919 % 1000).cast("double") / 2000).alias("lng"), (F.lit(39.6) + (k * 104729 % 1000).cast("double") / 2000).alias("lat"),
        (20 + k * 31 % 400).cast("double").alias("width_m"), (15 + k * 17 % 300).cast("double").alias("height_m"),
    )
    return f.withColumns({"x0": F.col("lng") - F.col("width_m") / 170000, "x1": F.col("lng") + F.col("width_m") / 170000, "y0": F.col("lat") - F.col("height_m") / 222000, "y1": F.col("lat") + F.col("height_m") / 222000})


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Evidence ledger of events: entity_id, seq, evidence_id, kind, category, overrides."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("evidence_id"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 80), "REFUTING").otherwise("SUPPORTING").alias("kind"),
        F.when(F.col("event_type").isin("view", "click"), "GEOMETRY").when(F.col("event_type") == "purchase", "AUDIT").otherwise("FINDING").alias("category"),
        F.when(F.col("event_id") % 7 == 3, F.array(F.col("event_id") - 3)).otherwise(F.array().cast("array<bigint>")).alias("overrides"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark runs of line items: case, experiment, candidates, overlaps and disposition."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("B"), F.col("l_linenumber").cast("string")).alias("experiment_id"), (F.col("l_quantity").cast("bigint") % 5).alias("candidate_count"),
        (F.col("l_discount") * 8).alias("top1_iou"), (F.col("l_discount") * 8 + F.col("l_tax") * 4).alias("oracle_iou"),
        F.when(F.col("l_returnflag") == "A", "TRUSTED").when(F.col("l_returnflag") == "N", "UNRESOLVED").otherwise("REJECTED").alias("disposition"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predicted confidences of orders and whether they were right."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), ((k * 37 % 1001).cast("double") / 1000).alias("confidence"), (k * 13 % 1000 < k * 37 % 1001).alias("correct"))
