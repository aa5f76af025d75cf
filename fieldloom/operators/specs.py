"""Transform specs of edges (source variable to target element): recodes, units, formulas, their confidence and review."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import answers as an
from fieldloom.functions import text as tx
from fieldloom.functions import values as vx
from fieldloom.operators.retrieval import triage

REVIEW_COVERAGE, REVIEW_CONFIDENCE = 0.8, 0.6
HIGH, MEDIUM, LOW = 0.9, 0.6, 0.4
COVERAGE_WEIGHT = 0.5


def codes(encoding: Column) -> Column:
    """The codes of an option list, in order."""
    return F.transform(vx.parse_options(F.coalesce(encoding, F.lit(""))), lambda o: o["code"])


def filled(source: Column, target: Column, known: Column) -> Column:
    """``vx.ordinal_fill`` as a Column over code arrays and a map; null where it doesn't apply."""
    whole = lambda c: F.transform(c, lambda x: F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x).try_cast("long")))
    by_value = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(F.trim(x).try_cast("long").alias("v"), x.alias("c")))), lambda x: x["c"])
    clean = lambda c: ~F.exists(whole(c), lambda x: x.isNull()) & (F.size(F.array_distinct(whole(c))) == F.size(c))
    n = F.size(source)
    shaped = F.coalesce((n >= 3) & (n == F.size(target)) & clean(source) & clean(target), F.lit(False))
    none = F.array().cast("array<string>")
    # Arrays that don't fit never make a map: equal keys would end the job.
    line = F.map_from_arrays(F.when(shaped, by_value(source)).otherwise(none), F.when(shaped, by_value(target)).otherwise(none))
    keys = F.map_keys(known)
    right = F.forall(keys, lambda k: F.coalesce(F.try_element_at(line, k) == F.try_element_at(known, k), F.lit(False)))
    return F.when(shaped & (F.size(keys) >= 2) & (F.size(keys) < n) & right, line)


def recode_specs(edges: DataFrame, source: str, target: str, payload: str) -> DataFrame:
    """``edges`` with the recode of each: kind, code_map, unmapped, coverage, confidence, needs_review, ordinal_filled.

    ``payload`` is the answer's object as JSON with code_map and confidence, bare or in a
    list under ``recodes``. Codes that the target lacks are dropped, an all but complete
    ordinal scale is filled, an identical map is kind identity and an empty one none.
    """
    inner = F.coalesce(F.get_json_object(payload, "$.recodes[0]"), F.col(payload))
    src, tgt = codes(F.col(source)), codes(F.col(target))
    t = edges.withColumns({"_src": src, "_tgt": tgt, "_in": inner})
    said = F.coalesce(F.from_json(F.get_json_object("_in", "$.code_map"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    t = t.withColumn("_map", F.map_filter(said, lambda k, v: v.isNotNull() & ((F.size("_tgt") == 0) | F.array_contains("_tgt", v))))
    t = t.withColumn("_full", filled(F.col("_src"), F.col("_tgt"), F.col("_map"))).withColumn("code_map", F.coalesce("_full", "_map")).withColumn("ordinal_filled", F.col("_full").isNotNull())
    n = F.size("code_map")
    coverage = F.round(F.coalesce(F.try_divide(n, F.size("_src")), F.lit(0.0)), 3)
    judged = an.clamped(F.col("_in"), "$.confidence")
    kind = F.when(n == 0, "none").when(F.forall(F.map_keys("code_map"), lambda k: F.try_element_at("code_map", k) == k), "identity").otherwise("categorical")
    t = t.withColumns({"kind": kind, "unmapped": F.array_sort(F.array_except(F.array_distinct("_src"), F.map_keys("code_map"))), "coverage": coverage})
    t = t.withColumn("confidence", F.round(COVERAGE_WEIGHT * F.least("coverage", F.lit(1.0)) + (1 - COVERAGE_WEIGHT) * judged, 3))
    return t.withColumn("needs_review", (F.col("coverage") < REVIEW_COVERAGE) | (judged < REVIEW_CONFIDENCE) | (n == 0)).drop("_src", "_tgt", "_in", "_map", "_full")


def unit_specs(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``edges`` with the spec of each numeric edge: kind (unit, identity), factor, base_offset, needs_units, needs_review, confidence.

    A known conversion inside one family; identity where it does nothing or both sides
    spell the same unknown unit; else a unit spec that needs units.
    """
    a = vx.canonical_units(edges, source, "_a_")
    t = vx.canonical_units(a, target, "_b_")
    same = F.col("_a_family") == F.col("_b_family")
    factor, offset = vx.conversion((F.col("_a_factor"), F.col("_a_offset")), (F.col("_b_factor"), F.col("_b_offset")))
    known = F.coalesce(same, F.lit(False))
    alike = F.coalesce((F.trim(source) != "") & (F.lower(F.trim(source)) == F.lower(F.trim(target))), F.lit(False))
    t = t.withColumns({"factor": F.when(known, factor), "base_offset": F.when(known, offset)})
    nothing = known & vx.is_identity(F.col("factor"), F.col("base_offset"))
    t = t.withColumn("kind", F.when(nothing | (~known & alike), "identity").otherwise("unit")).withColumn("needs_units", ~known & ~alike)
    t = t.withColumn("needs_review", F.col("needs_units")).withColumn("coverage", F.lit(None).cast("double")).withColumn("needs_data", F.lit(False)).withColumn("confidence", F.lit(0.0))
    return t.withColumn("confidence", spec_score()).drop("_a_family", "_a_canonical", "_a_factor", "_a_offset", "_b_family", "_b_canonical", "_b_factor", "_b_offset", "needs_data", "coverage")


def spec_score() -> Column:
    """Confidence of a spec from its columns kind, coverage, needs_units, needs_data, factor and confidence."""
    c = F.col
    coded = F.when(c("confidence") > 0, c("confidence")).when(c("coverage") >= 1.0, HIGH).when(c("coverage") > 0, MEDIUM).otherwise(LOW)
    unit = F.when(c("needs_units"), LOW).when(c("factor").isNotNull(), HIGH).otherwise(MEDIUM)
    formula = F.when(c("needs_data"), LOW).otherwise(F.greatest(F.lit(MEDIUM), c("confidence")))
    return F.when(c("kind") == "none", 0.0).when(c("kind") == "identity", HIGH).when(c("kind") == "categorical", coded).when(c("kind") == "unit", unit).when(c("kind") == "arithmetic", formula).otherwise(LOW)


def spec_review(confidence: Column) -> Column:
    return triage(confidence)


def formula_specs(edges: DataFrame, payload: str, known: tuple[str, ...] = ("source",)) -> DataFrame:
    """Edges whose answer holds a formula: (.., formula, kind, needs_data, needs_review, confidence).

    A bare name is identity and needs no review; every other formula does. One that uses
    more inputs than ``known`` needs data. Formulas that aren't plain arithmetic, and
    none, give no row.
    """
    @F.pandas_udf("struct<ok boolean, identity boolean, extra boolean>")
    def judge(formula: pd.Series) -> pd.DataFrame:
        out = []
        for f in formula:
            try:
                names = vx.formula_names(f) if f and f.lower() != "null" else None
            except (SyntaxError, ValueError):
                names = None
            out.append((names is not None and _plain(f), names is not None and vx.is_identity_formula(f), bool(names and names - set(known))))
        return pd.DataFrame(out, columns=["ok", "identity", "extra"])

    t = edges.withColumn("formula", F.trim(F.get_json_object(payload, "$.formula"))).where("formula is not null and formula <> ''").withColumn("_j", judge("formula")).where("_j.ok")
    t = t.withColumns({"kind": F.when(F.col("_j.identity"), "identity").otherwise("arithmetic"), "needs_data": F.col("_j.extra") & ~F.col("_j.identity"), "needs_review": ~F.col("_j.identity"), "needs_units": F.lit(False), "coverage": F.lit(None).cast("double"), "factor": F.lit(None).cast("double"), "confidence": F.lit(0.0)})
    return t.withColumn("confidence", spec_score()).drop("_j", "needs_units", "coverage", "factor")


def _plain(formula: str) -> bool:
    """Whether a formula is arithmetic over names and a few functions, told without a session."""
    allowed = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Constant, ast.Name, ast.Load, ast.Call, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow, ast.USub, ast.UAdd)
    calls = {*vx._CALLS, "round"}
    for n in ast.walk(ast.parse(formula, mode="eval")):
        if not isinstance(n, allowed) or (isinstance(n, ast.Call) and (not isinstance(n.func, ast.Name) or n.func.id not in calls or n.keywords)) or (isinstance(n, ast.Constant) and not isinstance(n.value, (int, float))):
            return False
    return True


def refinement_axes(records: DataFrame, specs: DataFrame) -> DataFrame:
    """(group_id, axis, reason): why the element of each refined record doesn't fit, from its specs (group_id, kind, unmapped, needs_units, needs_review).

    structural for a repeating measure, value_domain for codes without a target,
    representation for units that don't reconcile, else qualifier. Records without a
    concept are mis-assigned, those without specs give no evidence; only refine
    verdicts are judged.
    """
    flag = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    per = specs.groupBy("group_id").agg(flag(F.col("kind") == "wide_to_long").alias("wide"), flag(F.size("unmapped") > 0).alias("open"), flag(F.col("needs_units") | ((F.col("kind") == "unit") & F.col("needs_review"))).alias("units"), F.count("*").alias("n"))
    t = records.where("verdict = 'refine'").join(per, "group_id", "left")
    named = F.trim(F.coalesce("concept", F.lit(""))) != ""
    reason = F.when(~named, "mis_assigned").when(F.col("n").isNull(), "no_evidence")
    axis = F.when(reason.isNull(), F.when(F.col("wide"), "structural").when(F.col("open"), "value_domain").when(F.col("units"), "representation").otherwise("qualifier"))
    return t.select("group_id", axis.alias("axis"), reason.alias("reason"))


def deltas(refined: DataFrame, parents: DataFrame, key: str, slots: tuple[str, ...] = ("preferred_name", "definition", "question_text", "data_type", "units", "permissible_values")) -> DataFrame:
    """(key, changed, completed, delta_size, over_refined): what a refined element says otherwise than its parent, and what it fills in.

    Texts are compared without case and repeated white space; an empty new slot changes
    nothing, a slot that the parent lacks is completed. Value lists are compared as sets
    of labels. Over half of the slots changed, or no label kept, is over-refined.
    """
    norm = lambda c: F.lower(tx.squeeze(F.coalesce(c, F.lit(""))))
    labels = lambda c: F.array_distinct(F.transform(vx.parse_options(F.coalesce(c, F.lit(""))), lambda o: norm(o["label"])))
    t = refined.select(key, *(F.col(s).alias(f"_r_{s}") for s in slots)).join(parents.select(key, *(F.col(s).alias(f"_p_{s}") for s in slots)), key)
    changed, completed = [], []
    for s in slots:
        new, old = F.col(f"_r_{s}"), F.col(f"_p_{s}")
        if s == "permissible_values":
            a, b = labels(new), labels(old)
            differ = (F.size(a) > 0) & ((F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0))
            had = F.size(b) > 0
            replaced = had & (F.size(a) > 0) & (F.size(F.array_intersect(a, b)) == 0)
        else:
            differ, had = (norm(new) != "") & (norm(new) != norm(old)), norm(old) != ""
        changed.append(F.when(differ & had, F.lit(s)))
        completed.append(F.when(differ & ~had, F.lit(s)))
    t = t.withColumns({"changed": F.array_compact(F.array(*changed)), "completed": F.array_compact(F.array(*completed)), "_x": replaced})
    size = F.round(F.size("changed") / len(slots), 3)
    return t.select(key, "changed", "completed", size.alias("delta_size"), ((size > 0.5) | F.col("_x")).alias("over_refined"))


def closed_gaps(specs: DataFrame, labels: DataFrame, values: DataFrame) -> DataFrame:
    """Source codes without a target that a refined element has a value for: (spec_id, code, target).

    ``specs`` (spec_id, element_id, unmapped), ``labels`` (spec_id, code, label) and
    ``values`` (element_id, code, label) are joined by normalized label.
    """
    norm = lambda c: F.lower(tx.squeeze(F.col(c)))
    missing = specs.select("spec_id", "element_id", F.explode("unmapped").alias("code"))
    named = missing.join(labels.select("spec_id", "code", norm("label").alias("l")), ["spec_id", "code"])
    offered = values.select("element_id", F.col("code").alias("target"), norm("label").alias("l")).where("l <> ''")
    return named.join(offered, ["element_id", "l"]).groupBy("spec_id", "code").agg(F.min("target").alias("target"))


def repeating_measures(groups: DataFrame, label: str, share: float = 0.7, least: int = 4, density: float = 0.5) -> DataFrame:
    """(group_id, signature, n_members, n_occurrences, lo, hi, density): groups whose labels are one wording with running numbers; one wide-to-long spec for each."""
    sig = groups.where(F.col(label).isNotNull()).select("group_id", tx.signature(F.col(label)).alias("signature"), F.transform(F.regexp_extract_all(F.col(label), F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("long")).alias("nums"))
    count = sig.groupBy("group_id", "signature").agg(F.count("*").alias("n"))
    total = count.groupBy("group_id").agg(F.sum("n").alias("n_members"))
    top = count.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "signature"))).where("k = 1").where(F.contains("signature", F.lit("#")))
    spread = sig.select("group_id", "signature", F.explode("nums").alias("x")).groupBy("group_id", "signature").agg(F.count_distinct("x").alias("n_occurrences"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    t = top.join(total, "group_id").join(spread, ["group_id", "signature"]).withColumn("density", F.round(F.col("n_occurrences") / (F.col("hi") - F.col("lo") + 1), 6))
    return t.where((F.col("n") >= share * F.col("n_members")) & (F.col("n_occurrences") >= least) & (F.col("density") >= density)).select("group_id", "signature", "n_members", "n_occurrences", "lo", "hi", "density")
