"""Readers: dictionaries as CSV or TSV, catalogs as JSON, variable lists as XML, saved answers as JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text as tx
from fieldloom.operators.dictionary import ROLES, detect_roles


def delimiter_of(path: str, head: str) -> str:
    """By the file's ending, else the sign of ``, tab | ;`` that the first lines hold most evenly, else a comma."""
    if re.search(r"\.(tsv|tab)$", path, re.I):
        return "\t"
    if re.search(r"\.csv$", path, re.I):
        return ","
    lines = [x for x in head.splitlines()[:20] if x.strip()]
    best = max(",\t|;", key=lambda s: (min((x.count(s) for x in lines), default=0), sum(x.count(s) for x in lines)))
    return best if any(best in x for x in lines) else ","


def read_dictionary(spark: SparkSession, path: str, cohort: str, roles: dict[str, str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """One row per variable: cohort, ord, the role columns, and a map of all other columns.

    Every cell is text; blanks and NA tokens are null. ``roles`` names columns by hand;
    what it leaves out is found from the header. A file without a column for a name,
    description or question can't be read.
    """
    head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())
    sep = delimiter_of(path, head)
    raw = spark.read.options(header=True, sep=sep, multiLine=True, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE").csv(path)
    raw = raw.toDF(*(c.strip().lstrip("﻿") for c in raw.columns))
    found = detect_roles(raw.columns, roles)
    if not {"variable_name", "description", "short_label", "question_text"} & set(found):
        raise ValueError(f"no column of {path} names or describes its variables: {raw.columns}")
    missing = [c for c in (roles or {}).values() if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    cell = lambda c: tx.null_if_na(F.col(f"`{c}`"))
    rest = [c for c in raw.columns if c not in found.values()]
    other = F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in rest)), F.array(*(cell(c) for c in rest))), lambda _, v: v.isNotNull()) if rest else F.lit(None).cast("map<string,string>")
    cell_of = {r: cell(found[r]) if r in found else F.lit(None).cast("string") for r in ROLES}
    # A label stands in for a description that the file has no column for.
    cell_of["description"] = F.coalesce(cell_of["description"], cell_of["short_label"])
    cols = [c.alias(r) for r, c in cell_of.items()]
    return raw.select(F.lit(cohort).alias("cohort"), F.monotonically_increasing_id().alias("ord"), *cols, other.alias("metadata"))


CATALOG = (
    "tinyId string, designations array<struct<designation:string,tags:array<string>>>, definitions array<struct<definition:string>>,"
    "valueDomain struct<datatype:string,uom:string,permissibleValues:array<struct<permissibleValue:string,valueMeaningName:string,valueMeaningCode:string,codeSystemName:string>>>,"
    "classification array<struct<stewardOrg:struct<name:string>,elements:array<struct<name:string>>>>, registrationState struct<registrationStatus:string>, ids array<struct<source:string,id:string>>"
)


def flatten_catalog(records: DataFrame) -> DataFrame:
    """Nested catalog records (schema ``CATALOG``) as flat text columns."""
    question = F.filter("designations", lambda d: F.exists(d["tags"], lambda t: t.contains("Question")))
    pv = F.col("valueDomain.permissibleValues")
    join = lambda items, sign: F.nullif(F.array_join(items, sign), F.lit(""))
    return records.select(
        F.col("tinyId").alias("tinyid"),
        F.try_element_at("designations", F.lit(1))["designation"].alias("designation"),
        F.try_element_at(question, F.lit(1))["designation"].alias("question_text"),
        F.try_element_at("definitions", F.lit(1))["definition"].alias("definition"),
        F.col("valueDomain.datatype").alias("datatype"),
        F.col("valueDomain.uom").alias("uom"),
        join(F.transform(pv, lambda p: F.concat_ws("=", p["permissibleValue"], p["valueMeaningName"])), "|").alias("permissible_values"),
        join(F.filter(F.transform(pv, lambda p: F.concat(F.coalesce(p["codeSystemName"], F.lit("")), F.lit(":"), p["valueMeaningCode"])), lambda x: x.isNotNull()), "; ").alias("concept_codes"),
        join(F.flatten(F.transform("classification", lambda c: F.transform(c["elements"], lambda e: e["name"]))), "; ").alias("classification"),
        F.try_element_at("classification", F.lit(1))["stewardOrg"]["name"].alias("steward_org"),
        F.col("registrationState.registrationStatus").alias("registration_status"),
        join(F.transform("ids", lambda i: F.concat_ws(":", i["source"], i["id"])), "; ").alias("external_ids"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return flatten_catalog(spark.read.schema(CATALOG).option("multiLine", True).json(path))


def read_variable_xml(spark: SparkSession, path: str, cap: int = 100) -> DataFrame:
    """XML variable lists: id, name, description, type, unit and up to ``cap`` values as code=label."""
    schema = "_id string, name string, description string, type string, unit string, value array<struct<_code:string,_VALUE:string>>"
    v = spark.read.format("xml").option("rowTag", "variable").schema(schema).load(path)
    pairs = F.array_join(F.transform("value", lambda x: F.concat_ws("=", x["_code"], F.trim(x["_VALUE"]))), "|")
    return v.where(F.trim("name") != "").select(F.col("_id").alias("field_id"), F.trim("name").alias("variable_name"), "description", F.col("type").alias("data_type"), F.col("unit").alias("units"), F.when(F.size("value").between(1, cap), pairs).alias("value_encoding"))


def with_answers(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts with their saved answers; null where none was saved."""
    return prompts.join(answers.select("id", "response").dropDuplicates(["id"]), "id", "left")


def unanswered(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    return prompts.join(answers, "id", "left_anti")
