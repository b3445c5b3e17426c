"""Queries of the general problems 3 and 4 over the packet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.nested_json import flatten
from packetloom.operators.packed_values import long_form, unpack
from packetloom.session import table


def packed_rows(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("forms_text", "diagnosis_text", "icd_codes")) -> DataFrame:
    """(field, row_key, text) of the packed fields."""
    of_runs = [f for f in fields if f != "icd_codes"]
    out = long_form(table(spark, sf_dir, "packet_runs", ["id", *of_runs]), F.col("id"), of_runs) if of_runs else None
    if "icd_codes" in fields:
        codes = long_form(table(spark, sf_dir, "packet", ["packet_id", "icd_codes"]), F.col("packet_id"), ["icd_codes"])
        out = codes if out is None else out.unionByName(codes)
    return out


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every packed field, lone values included."""
    return unpack(packed_rows(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of fields that hold two or more."""
    return p3_values(spark, sf_dir).where("of >= 2").select("field", "row_key", "pos", "value")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, text) of the nested JSON columns."""
    runs = long_form(table(spark, sf_dir, "packet_runs", ["id", "fields_json", "intel_summary_json"]), F.col("id"), ["fields_json", "intel_summary_json"])
    events = long_form(table(spark, sf_dir, "packet_events", ["id", "details_json"]), F.col("id"), ["details_json"])
    return runs.unionByName(events).select("field", F.col("row_key").cast("bigint").alias("row_id"), "text").where(F.col("text").isNotNull())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an array element in the JSON columns, with its parent."""
    return flatten(json_rows(spark, sf_dir))
