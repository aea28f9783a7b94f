"""Relational inputs of the operators: the tables with rows that were delivered again taken once, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvaspark.common import table


# Rows of one key differ in their arrival only. Taking one row per key, not one per distinct row, leaves columns that a query doesn't need out of the scan and out of the shuffle.


def offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "course_offerings").drop("ingested_at").dropDuplicates(["offering_id"])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "course_catalog").drop("ingested_at").dropDuplicates(["course_code"])


def syllabi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "syllabus_courses").drop("parsed_at").dropDuplicates(["entry_id"])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blocks").drop("loaded_at").dropDuplicates(["node_id"])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "query_log").drop("received_at").dropDuplicates(["query_id"])


OFF = "off as (select distinct * exclude (ingested_at) from course_offerings)"
CAT = "cat as (select distinct * exclude (ingested_at) from course_catalog)"
SYL = "syl as (select distinct * exclude (parsed_at) from syllabus_courses)"
BLK = "blk as (select distinct * exclude (loaded_at) from blocks)"
LOG = "lg as (select distinct * exclude (received_at) from query_log)"
