"""Catalog elements: how canonical and rich they are, anchors of groups, documents, proposals for revision, review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text as tx
from fieldloom.functions import values as vx
from fieldloom.operators import groups as gx
from fieldloom.operators.families import magnets

_filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))


def canonicalness(category: Column, codes: Column) -> Column:
    """Collections of an element (parts between semicolons) and a fifth for each code (parts between bars or semicolons)."""
    parts = lambda c, sep: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x) != ""))
    return F.round(parts(category, ";") + 0.2 * parts(codes, "[|;]"), 6)


def richness(definition: Column, question: Column, n_options: Column, data_type: Column, units: Column, category: Column) -> Column:
    """2 for a definition, 1 for a question of its own, 1 to 1.5 for options, a half each for type, units and category."""
    one = lambda test, value: F.when(test, value).otherwise(F.lit(0.0))
    known = _filled(definition) & (definition != "No definition available")
    options = F.coalesce(n_options, F.lit(0))
    own = _filled(question) & ~question.eqNullSafe(definition)
    return F.round(one(known, F.lit(2.0)) + one(own, F.lit(1.0)) + one(options > 0, 1 + F.least(options, F.lit(5)) * 0.1) + one(_filled(data_type), F.lit(0.5)) + one(_filled(units), F.lit(0.5)) + one(_filled(category), F.lit(0.5)), 6)


def anchors(members: DataFrame, catalog: str, dim: int) -> DataFrame:
    """(group_id, n_members, medoid, has_element, anchor, anchor_cos): the element of each group closest to its medoid.

    ``members`` (group_id, key, cohort, vec, canonical, rich): rows of the cohort
    ``catalog`` are elements. Ties go to the more canonical, then the richer one, then
    by key. Groups of one member have none. The medoid is told by sums, see ``gx.dual_sample``.
    """
    unit = members.where(vx.norm(F.col("vec")) > 0)
    cents = gx.centroids(unit, ["group_id"], "vec", dim).where("n >= 2")
    near = gx.to_centroid(unit, cents, ["group_id"], "vec")
    medoid = near.withColumn("_r", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("cos"), "key"))).where("_r = 1").select("group_id", F.col("key").alias("medoid"), F.col("vec").alias("_m"), F.col("n").alias("n_members"))
    elements = unit.where(F.col("cohort") == catalog).join(medoid.select("group_id", "_m"), "group_id").withColumn("s", F.round(vx.cosine(F.col("vec"), F.col("_m")), 6))
    r = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("s"), F.desc("canonical"), F.desc("rich"), "key"))
    best = elements.withColumn("_r", r).where("_r = 1").select("group_id", F.col("key").alias("anchor"), F.col("s").alias("anchor_cos"))
    return medoid.drop("_m").join(best, "group_id", "left").select("group_id", "n_members", "medoid", F.col("anchor").isNotNull().alias("has_element"), "anchor", "anchor_cos")


def documents(elements: DataFrame, source: str = "fieldloom", steward: str = "") -> DataFrame:
    """(element_id, document): each element as a repository document in JSON, shaped for submission but never submitted.

    ``elements``: element_id, preferred_name, definition, question_text, data_type, units,
    permissible_values, cohorts (array), n_variables, parent_id, axis. Slots that only
    the repository assigns stay empty.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    named = F.array_compact(F.array(F.when(text("preferred_name") != "", F.struct(text("preferred_name").alias("designation"), F.array().cast("array<string>").alias("tags"))), F.when(text("question_text") != "", F.struct(text("question_text").alias("designation"), F.array(F.lit("Preferred Question Text")).alias("tags")))))
    defined = F.array_compact(F.array(F.when(text("definition") != "", F.struct(text("definition").alias("definition"), F.array(F.lit(source)).alias("sources")))))
    options = F.transform(vx.parse_options(F.coalesce("permissible_values", F.lit(""))), lambda o: F.struct(o["code"].alias("permissibleValue"), o["label"].alias("valueMeaningName")))
    kind = F.when(F.size(options) > 0, "Value List").when(text("units") != "", "Number").when(F.lower(text("data_type")).rlike("int|dec|num|float|double|continuous"), "Number").when(F.lower(text("data_type")).rlike("date"), "Date").otherwise("Text")
    domain = F.struct(kind.alias("datatype"), F.nullif(text("units"), F.lit("")).alias("uom"), options.alias("permissibleValues"))
    where = F.when(F.size("cohorts") > 0, F.array_join("cohorts", ", ")).otherwise("the source cohorts")
    told = F.when(F.col("parent_id").isNotNull(), F.concat(F.lit(f"{source}: refinement of element '"), "parent_id", F.lit("' (axis: "), F.coalesce("axis", F.lit("unspecified")), F.lit("), derived from "), F.col("n_variables").cast("string"), F.lit(" harmonized variable(s) across "), where, F.lit("."))).otherwise(
        F.concat(F.lit(f"{source}: generated from "), F.col("n_variables").cast("string"), F.lit(" harmonized variable(s) across "), where, F.lit(" that matched no existing element."))
    )
    doc = F.struct(
        F.lit("").alias("tinyId"), F.lit("cde").alias("elementType"), F.struct(F.lit(steward).alias("name")).alias("stewardOrg"), F.lit(False).alias("nihEndorsed"), F.struct(F.lit("Candidate").alias("registrationStatus")).alias("registrationState"),
        named.alias("designations"), defined.alias("definitions"), domain.alias("valueDomain"), F.array(F.struct(told.alias("sourceName"))).alias("sources"), F.array().cast("array<string>").alias("derivationRules"),
    )
    return elements.select("element_id", F.to_json(doc, {"ignoreNullFields": "true"}).alias("document"))


def revision_proposals(elements: DataFrame) -> DataFrame:
    """(parent_id, n_groups, n_over_refined, axes, cohorts, n_variables, units_proposed, element_ids): refined elements by parent, most groups first.

    ``elements``: element_id, parent_id, axis, cohorts (array), n_variables, units, over_refined.
    """
    own = elements.where("parent_id is not null and parent_id <> ''")
    base = own.groupBy("parent_id").agg(F.count("*").alias("n_groups"), F.sum(F.col("over_refined").cast("int")).alias("n_over_refined"), F.array_join(F.array_sort(F.collect_set("axis")), ",").alias("axes"), F.sum("n_variables").alias("n_variables"), F.array_join(F.array_sort(F.collect_set(F.nullif("units", F.lit("")))), ",").alias("units_proposed"), F.array_join(F.array_sort(F.collect_list("element_id")), ",").alias("element_ids"))
    places = own.select("parent_id", F.explode("cohorts").alias("c")).distinct().groupBy("parent_id").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("cohorts"))
    return base.join(places, "parent_id", "left").orderBy(F.desc("n_groups"), "parent_id")


def review_rows(members: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of a match review: one for each question of an assigned group, with its variables, cohorts, target and a catch-all flag.

    ``members`` (group_id, cohort, variable_name, question_text, description, data_type,
    n_options), ``records`` (group_id, verdict, cde_id, chosen_cos, top1_cos). Questions
    that ask for open text are routed apart by ``free_text``.
    """
    asked = members.where(F.trim(F.coalesce("question_text", "description", F.lit(""))) != "").withColumn("question", tx.squeeze(F.coalesce(F.nullif(F.trim("question_text"), F.lit("")), F.trim("description"))))
    taken = records.where("verdict in ('adopt', 'refine') and cde_id is not null")
    free = tx.looks_free_text(F.col("question_text"), F.lit(None).cast("string"), F.col("variable_name"), F.col("data_type"), F.col("n_options"))
    per = asked.withColumn("free", free).groupBy("group_id", "question").agg(
        F.min(F.struct("cohort", "variable_name", "free")).alias("f"), F.count("*").alias("n_vars_sharing"), F.count_distinct("cohort").alias("n_cohorts")
    )
    rows = per.join(taken.select("group_id", "verdict", "cde_id", F.coalesce("chosen_cos", "top1_cos", F.lit(0.0)).alias("match_cosine")), "group_id")
    rows = rows.select("group_id", "question", F.concat_ws(":", "f.cohort", "f.variable_name").alias("source_id"), F.col("f.free").alias("free_text"), "n_vars_sharing", (F.col("n_cohorts") >= 2).alias("cross_cohort"), F.col("verdict").alias("pair_type"), F.col("cde_id").alias("target_id"), F.round("match_cosine", 4).alias("match_cosine"))
    return magnets(rows, "target_id")
