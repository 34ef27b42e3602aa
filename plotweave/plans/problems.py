"""Queries of the general training-data operators (p1, p2, p5, p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import table
from ..operators import drift, proximity, snapshots, units


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(table(spark, d, "raw_records"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_records(table(spark, d, "raw_records"))


def p1_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return drift.unmapped_columns(table(spark, d, "raw_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "buildings")).select("epoch", "kind", "fid").distinct()


def p2_events(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "buildings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    areas = units.legacy_areas(table(spark, d, "parcels_legacy"))
    return areas.filter("area_unit <> 'bigha'").select("fid", "area_unit", F.round("area_sqm").cast("long").alias("area_sqm"))


def p5_areas(spark: SparkSession, d: str) -> DataFrame:
    return units.legacy_areas(table(spark, d, "parcels_legacy"))


def p5_claims(spark: SparkSession, d: str) -> DataFrame:
    return units.claim_areas(table(spark, d, "claims"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.relations(*(table(spark, d, t) for t in ("survey_points", "parcels", "govt_land", "buildings")))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_unmapped, p2_found, p2_events, p5_found, p5_areas, p5_claims, p6_found)}
ORACLE: dict[str, str] = {}
