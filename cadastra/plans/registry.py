"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import profile, proximity
from ..sources.tables import table
from . import files, names, reference, shapes, worlds  # noqa: F401


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.location_hits(table(spark, d, "source_records"), table(spark, d, "landuse_faces"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.departures(table(spark, d, "source_records"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.mask_profile(table(spark, d, "source_records"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p5_found": p5_found, "p5_profile": p5_profile, "p7_found": p7_found, **reference.QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(reference.SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return reference.work_tiers(spark, d)
