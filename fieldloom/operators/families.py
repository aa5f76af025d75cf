"""Families of numbered or templated labels, wide-to-long specs, review flags, answers in free form."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text as tx
from fieldloom.runtime import broadcast_if_small, stage


def enumerated_families(rows: DataFrame, group: str, label: str, members: int = 8, share: float = 0.7, template: int = 3, slot: int = 3, fraction: float = 0.6) -> DataFrame:
    """(group, template, n_members, n_slots): groups whose labels share a template of words and differ in a short slot.

    Template words occur in at least ``share`` of the labels; there are at least ``template``
    of them, at least ``members`` distinct slots of at most ``slot`` words, in at least
    ``fraction`` of the labels.
    """
    t = rows.where(F.col(group).isNotNull() & F.col(label).isNotNull()).select(F.col(group).alias("g"), F.col(label).alias("l")).distinct().withColumn("ts", F.array_distinct(tx.tokens(F.col("l"), 1)))
    n = t.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= members)
    df = t.select("g", F.explode("ts").alias("w")).groupBy("g", "w").agg(F.count("*").alias("df"))
    words = df.join(n, "g").where(F.col("df") >= share * F.col("n")).groupBy("g", "n").agg(F.array_sort(F.collect_list("w")).alias("tw")).where(F.size("tw") >= template)
    fit = t.join(words, "g").withColumn("slot", F.array_except("ts", "tw")).where((F.size(F.array_intersect("ts", "tw")) == F.size("tw")) & F.size("slot").between(1, slot))
    out = fit.groupBy("g", "n", "tw").agg(F.count("*").alias("fits"), F.count_distinct(F.array_join(F.array_sort("slot"), " ")).alias("n_slots"))
    return out.where((F.col("n_slots") >= members) & (F.col("fits") >= fraction * F.col("n"))).select(F.col("g").alias(group), F.array_join("tw", " ").alias("template"), F.col("n").alias("n_members"), "n_slots")


def wide_to_long_specs(fields: DataFrame, scope: str, name: str, key: str, least: int = 3) -> DataFrame:
    """(scope, stem, n_columns, columns): numbered variables of one stem, to be turned into rows."""
    stem, num = F.regexp_extract(name, r"^(.*?)[._]?([0-9]+)$", 1), F.regexp_extract(name, r"^(.*?)[._]?([0-9]+)$", 2)
    t = fields.where(F.col(name).rlike("[A-Za-z].*[0-9]$")).select(scope, F.lower(stem).alias("stem"), num.try_cast("long").alias("num"), F.col(name).alias("column"), key)
    one = t.groupBy(scope, "stem", "num").agg(F.min("column").alias("column"))
    g = one.groupBy(scope, "stem").agg(F.count("*").alias("n_columns"), F.array_sort(F.collect_list(F.struct("num", "column"))).alias("c"))
    return g.where(F.col("n_columns") >= least).select(scope, "stem", "n_columns", F.array_join(F.transform("c", lambda x: x["column"]), ",").alias("columns"))


def magnets(rows: DataFrame, target: str, least: int = 8) -> DataFrame:
    """``magnet``: whether a target draws ``least`` or more rows; false for rows without a target.

    Targets are counted with partial sums and joined back, so none is gathered.
    """
    often = rows.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(target, F.lit(True).alias("magnet"))
    return rows.join(broadcast_if_small(stage(often, "magnets")), target, "left").withColumn("magnet", F.coalesce("magnet", F.lit(False)))


def label_coverage(observed: DataFrame, offered: DataFrame, key: str, label: str) -> DataFrame:
    """(key, n_observed, coverage): share of a key's observed labels that are offered, by normalized text; 1 where none is observed."""
    norm = F.lower(F.trim(F.regexp_replace(F.col(label), r"\s+", " ")))
    o = observed.where(F.col(label).isNotNull()).select(key, norm.alias("l")).distinct()
    f = offered.where(F.col(label).isNotNull()).select(key, norm.alias("l"), F.lit(1).alias("hit")).distinct()
    cov = o.join(f, [key, "l"], "left").groupBy(key).agg(F.count("*").alias("n_observed"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"))
    every = observed.select(key).union(offered.select(key)).distinct()
    return every.join(cov, key, "left").fillna({"n_observed": 0, "coverage": 1.0})


def moved_members(groups: DataFrame, moves: DataFrame) -> DataFrame:
    """Members after a reviewer's moves (member, to): (member, group, moved). Moves to unknown groups are refused."""
    unknown = moves.join(groups.select(F.col("group").alias("to")).distinct(), "to", "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"unknown groups: {[r['to'] for r in unknown.limit(5).collect()]}")
    return groups.join(moves, "member", "left").select("member", F.coalesce("to", "group").alias("group"), (F.col("to").isNotNull() & (F.col("to") != F.col("group"))).alias("moved"))


def cut_point(threshold: Column) -> Column:
    """The one number of a threshold's wording; null for none or for a band."""
    found = F.regexp_extract_all(threshold, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.when(F.size(found) == 1, found[0].try_cast("double"))


def clamp(value: Column) -> Column:
    """A text or number as a confidence in [0, 1]; 0 where it isn't one."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value.try_cast("double"))), F.lit(0.0))


def salvage(text: str) -> list[str]:
    """Every complete JSON object at the outermost level of ``text``, whatever stands around or is cut off."""
    out, decoder, i = [], json.JSONDecoder(), 0
    while (i := text.find("{", i)) >= 0:
        try:
            value, end = decoder.raw_decode(text, i)
            out.append(json.dumps(value, sort_keys=True, ensure_ascii=False))
            i = end
        except ValueError:
            i += 1
    return out


def salvaged(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, object): the objects of each answer; answers without one give no row."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k + 1, o) for i, t in enumerate(b.column(1).to_pylist()) if t for k, o in enumerate(salvage(t))]
            a = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(a[0], pa.int32())), pa.array(a[1], pa.int32()), pa.array(a[2], pa.string())], names=[key, "pos", "object"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, pos int, object string")
