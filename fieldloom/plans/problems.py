"""Queries of the general data-preparation problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import packed_values, rejects
from fieldloom.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "dictionary_fields").select("row_id", "value_encoding")
    return packed_values.split_packed(fields, "value_encoding").select("row_id", "pos", "item")


def p2_option_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields hold each option label, over all packed fields."""
    fields = table(spark, sf_dir, "dictionary_fields").select("row_id", "value_encoding")
    return packed_values.split_packed(fields, "value_encoding").groupBy("item").agg(F.count("*").alias("n_fields"), F.min("pos").alias("first_pos"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.parse_records(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "raw_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(_parsed(spark, sf_dir)).select("line_id", "reason")


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good records of all files, every cell: columns by role, the rest as JSON."""
    return rejects.by_role(_parsed(spark, sf_dir), table(spark, sf_dir, "raw_files"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_option_counts, p5_found, p5_loaded)}


def oracle_sql() -> dict[str, str]:
    return {}
