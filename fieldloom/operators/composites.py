"""Composite scores: which cohorts can compute them from matched components, and the recipe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 0.5


def rolled_up(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, group_id, aggregate, n_matched, n_total, rank): variables rated for a component, rolled up to the groups that own them.

    ``rated`` (component, cohort, variable_name, confidence), ``groups`` (group_id,
    cohort, variable_name). The mean of a group's ratings ranks it, then its best one,
    then its id; variables outside all groups drop out.
    """
    own = groups.groupBy("cohort", "variable_name").agg(F.min("group_id").alias("group_id"))
    total = own.groupBy("group_id").agg(F.count("*").alias("n_total"))
    per = rated.join(own, ["cohort", "variable_name"]).groupBy("component", "group_id").agg(F.round(F.avg("confidence"), 4).alias("aggregate"), F.max("confidence").alias("best"), F.count("*").alias("n_matched"))
    r = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("aggregate"), F.desc("best"), "group_id"))
    return per.withColumn("rank", r).join(total, "group_id").select("component", "group_id", "aggregate", "n_matched", "n_total", "rank")


def coverage(rated: DataFrame, groups: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(component, cohort, n_members, best): cohorts that have an accepted variable of a component inside some group."""
    own = groups.select("cohort", "variable_name").distinct()
    return rated.where(F.col("confidence") >= floor).join(own, ["cohort", "variable_name"]).groupBy("component", "cohort").agg(F.count_distinct("variable_name").alias("n_members"), F.max("confidence").alias("best"))


def feasibility(components: DataFrame, covered: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(cohort, n_required, n_present, missing, computable, verdict): whether each cohort can compute the score, and the score as a whole.

    ``components`` (component, required); where none is required, all are. ``covered``
    (component, cohort). A cohort computes it when no required component is missing.
    The verdict is full, partial or infeasible by the required components that any
    cohort covers.
    """
    any_required = components.agg(F.coalesce(F.max(F.col("required").cast("int")), F.lit(0)).alias("any"))
    need = components.crossJoin(F.broadcast(any_required)).where((F.col("any") == 0) | F.col("required")).select("component")  # one row
    total = need.agg(F.count("*").alias("n_required"))
    met = need.join(covered.select("component").distinct(), "component").agg(F.count("*").alias("n_met"))
    have = covered.select("component", "cohort").distinct().withColumn("hit", F.lit(1))
    grid = cohorts.select("cohort").distinct().crossJoin(F.broadcast(need))  # components of one score
    per = grid.join(have, ["component", "cohort"], "left").groupBy("cohort").agg(F.count("hit").alias("n_present"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("component")))), ",").alias("missing"))
    out = per.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(met))  # one row each
    verdict = F.when((F.col("n_required") > 0) & (F.col("n_met") == F.col("n_required")), "full").when(F.col("n_met") > 0, "partial").otherwise("infeasible")
    return out.select("cohort", "n_required", "n_present", "missing", ((F.col("n_required") > 0) & (F.col("n_present") == F.col("n_required"))).alias("computable"), verdict.alias("verdict"))


def slug(name: Column) -> Column:
    out = F.lower(F.regexp_replace(F.regexp_replace(name, "[^0-9a-zA-Z]+", "_"), "^_+|_+$", ""))
    return F.when(out == "", "component").otherwise(out)


def coding_step(component: Column, column: Column, kind: Column, rule: Column) -> Column:
    """The coding of one component as a line of the recipe. What can't be authored is marked for review, never guessed."""
    target, quoted = slug(component), F.concat(F.lit("'"), column, F.lit("'"))
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    stated = F.coalesce(rule, F.lit("")) != ""
    return (
        F.when((kind == "threshold") & stated, line(target, " = outside(", quoted, ", '", rule, "')  # 1 outside the stated range, else 0"))
        .when((kind == "categorical") & stated, line(target, " = map(", quoted, ", ", rule, ")"))
        .when(kind == "identity", line(target, " = ", quoted))
        .when(kind == "unit", line(target, " = convert(", quoted, ", to='", F.coalesce(rule, F.lit("?")), "')  # REVIEW: confirm the conversion"))
        .when(kind == "arithmetic", line("# REVIEW: ", target, " = ", F.coalesce(rule, F.lit("<formula not stated>")), "  (over ", column, ")"))
        .when(kind == "data_dependent", line("# APPLY-TIME: ", target, " = sample_relative(", quoted, ", '", F.coalesce(rule, F.lit("as stated")), "')"))
        .otherwise(line("# REVIEW: ", target, " = ?  # no coding rule is stated (over ", column, ")"))
    )


def cut_rule(threshold: Column) -> Column:
    """The one cut of a threshold's wording as operator and number; empty for bands and for none. At least, where no operator is given."""
    t = F.translate(F.regexp_replace(F.regexp_replace(F.coalesce(threshold, F.lit("")), "≥", ">="), "≤", "<="), "", "")
    numbers = F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    operator, first = F.regexp_extract(t, r"(>=|<=|>|<)?\s*([0-9]+(?:\.[0-9]+)?)", 1), F.regexp_extract(t, r"(>=|<=|>|<)?\s*([0-9]+(?:\.[0-9]+)?)", 2)
    bands = (F.size(numbers) > 2) | ((F.size(numbers) == 2) & ~t.rlike("[<>]") & t.rlike(r"[0-9]\s*(?:[-–]|to)\s*[0-9]"))
    return F.when(bands | (first == ""), "").otherwise(F.concat(F.when(operator == "", ">=").otherwise(operator), F.lit(" "), first))


def combination(kind: str, components: list[str], weights: list[float | None] | None = None) -> str:
    """The last line of the recipe over the slugs of the matched components."""
    n, joined = len(components), " + ".join(components)
    if not n:
        return "# NOT COMPUTABLE: no component of this score matched"
    if kind in ("sum", "criteria_count"):
        return f"score = {joined}"
    if kind == "deficit_proportion":
        return f"score = ({joined}) / {n}"
    if kind == "weighted_sum":
        if weights and len(weights) == n and all(w is not None for w in weights):
            return "score = " + " + ".join(f"{w} * {c}" for w, c in zip(weights, components, strict=True))
        return f"# REVIEW: score = weighted sum of ({joined}): weights are incomplete"
    if kind == "z_composite":
        return "# APPLY-TIME: score = mean(" + ", ".join(f"z({c})" for c in components) + ")"
    return f"# REVIEW: apply the stated rule to ({joined})"
