"""Reports over groups, retrieval and costs, each callable on any table of the right columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text as tx
from fieldloom.functions import values as vx


def gate_modes(fields: DataFrame, group: str, cohort: str, encoding: str, share: float = 0.5) -> DataFrame:
    """(group, n_cohorts, coded, mode): how a group can be harmonized, by its cohorts and the share of its fields with codes."""
    coded = F.round(F.avg(F.when(F.col(encoding).isNotNull(), 1.0).otherwise(0.0)), 6)
    g = fields.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(cohort).alias("n_cohorts"), coded.alias("coded"))
    return g.withColumn("mode", F.when(F.col("n_cohorts") < 2, "single_cohort").when(F.col("coded") >= share, "harmonize_values").otherwise("harmonize_text"))


def cost_ledger(calls: DataFrame, stage: str, tokens: str, price: Column, batch: Column | None = None) -> DataFrame:
    """(stage, calls, tokens, usd): what each stage cost; batches cost half."""
    rate = price * (F.when(batch, 0.5).otherwise(1.0) if batch is not None else F.lit(1.0))
    return calls.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("calls"), F.round(F.sum(tokens), 4).alias("tokens"), F.round(F.sum(F.col(tokens) * rate), 6).alias("usd"))


def prices(model: Column, table: Mapping[str, float], fallback: float) -> Column:
    """Price of a token by the longest prefix of ``table`` that the model's name starts with."""
    out = None
    for prefix in sorted(table, key=len, reverse=True):
        out = F.when(F.startswith(model, F.lit(prefix)), table[prefix]) if out is None else out.when(F.startswith(model, F.lit(prefix)), table[prefix])
    return F.lit(fallback) if out is None else out.otherwise(fallback)


def concept_digest(fields: DataFrame, group: str, cohort: str, most: int = 40) -> DataFrame:
    """(group, n_cohorts, n_members): the ``most`` best connected groups of two cohorts or more."""
    g = fields.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(cohort).alias("n_cohorts"), F.count("*").alias("n_members"))
    return g.where("n_cohorts >= 2").orderBy(F.desc("n_cohorts"), F.desc("n_members"), group).limit(most)


def spread(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mean, deviation, n): mean and population deviation of a number."""
    return rows.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 4).alias("deviation"), F.count(value).alias("n"))


def recall_at(ranked: DataFrame, hit: Column, ks: tuple[int, ...]) -> DataFrame:
    """(k, recall): the share of queries with a hit among their first k; ``ranked`` has q and rank."""
    first = ranked.groupBy("q").agg(F.min(F.when(hit, F.col("rank"))).alias("r"))
    each = first.select("r", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"))
    return each.groupBy("k").agg(F.round(F.avg(F.when(F.col("r") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("recall"))


def diverse(ranked: DataFrame, group: str, groups: int = 3, inside: int = 4) -> DataFrame:
    """``ranked`` (q, d, rank, group) cut to the ``groups`` best groups of each query and ``inside`` of each, with group_rank and inside."""
    best = ranked.groupBy("q", group).agg(F.min("rank").alias("best")).withColumn("group_rank", F.row_number().over(Window.partitionBy("q").orderBy("best"))).where(F.col("group_rank") <= groups)
    m = ranked.join(best, ["q", group]).withColumn("inside", F.row_number().over(Window.partitionBy("q", group).orderBy("rank")))
    return m.where(F.col("inside") <= inside)


def formula_share(rows: DataFrame, group: str, expected: Column, formula: str, inputs: Mapping[str, Column], relative: float = 1e-6, absolute: float = 1e-9) -> DataFrame:
    """(group, share): the share of rows for which a formula gives the expected value within the tolerance."""
    got = vx.compile_formula(formula, inputs)
    right = F.abs(got - expected) <= F.greatest(relative * F.abs(expected), F.lit(absolute))
    return rows.groupBy(group).agg(F.round(F.avg(F.when(F.coalesce(right, F.lit(False)), 1.0).otherwise(0.0)), 6).alias("share"))


def observed_labels(fields: DataFrame, group: str, key: str, encoding: str) -> DataFrame:
    """(group, label, first_row, n): the answer labels that a group's fields offer, without those for missing answers."""
    t = fields.where(F.col(encoding).isNotNull() & F.col(group).isNotNull())
    e = t.select(group, key, F.explode(vx.parse_options(F.col(encoding))).alias("o")).where(~tx.is_sentinel(F.col("o.label")))
    return e.groupBy(group, F.lower("o.label").alias("label")).agg(F.min(key).alias("first_row"), F.count("*").alias("n"))


#: Words of names that qualify a concept (fixed values of common English axes).
QUALIFIERS = ["home", "work", "mailing", "employment", "residence", "residential", "business", "office", "mother", "father", "maternal", "paternal", "left", "right", "upper", "lower"]


def diverging_qualifiers(fields: DataFrame, group: str, name: str) -> DataFrame:
    """(group, qualifiers): groups whose names carry different qualifying words, as home and work: concepts that one text hides."""
    words = tx.words_of_name(F.col(name))
    own = fields.where(F.col(group).isNotNull()).select(group, F.array_join(F.array_sort(F.array_intersect(words, F.array(*map(F.lit, QUALIFIERS)))), " ").alias("q")).where("q <> ''").distinct()
    return own.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set("q")), ",").alias("qualifiers"), F.count("*").alias("n")).where("n >= 2").drop("n")


def matrix_suspects(fields: DataFrame, group: str, label: str, share: float = 0.6, least: int = 6) -> DataFrame:
    """(group, n_members, n_skeletons): groups of ``least`` labels or more that fall into a few wordings with one varying slot each.

    A word is part of the slot when it is a number or when under a tenth of the group's
    labels, or only one, hold it.
    """
    t = fields.where(F.col(group).isNotNull() & F.col(label).isNotNull()).select(group, F.col(label).alias("l")).distinct().withColumn("ts", tx.tokens(F.col("l"), 1))
    n = t.groupBy(group).agg(F.count("*").alias("n_members")).where(F.col("n_members") >= least)
    df = t.select(group, F.explode(F.array_distinct("ts")).alias("w")).groupBy(group, "w").agg(F.count("*").alias("df"))
    stable = df.join(n, group).where((F.col("df") > F.greatest(F.lit(1), F.floor(F.col("n_members") / 10))) & ~F.col("w").rlike("^[0-9]+$")).groupBy(group).agg(F.collect_set("w").alias("words"))
    sk = t.join(stable, group).select(group, F.regexp_replace(F.array_join(F.transform("ts", lambda w: F.when(F.array_contains("words", w), w).otherwise("·")), " "), "·( ·)+", "·").alias("s")).where(F.contains("s", F.lit("·")))
    per = sk.groupBy(group, "s").agg(F.count("*").alias("c")).where("c >= 2").groupBy(group).agg(F.count("*").alias("n_skeletons"), F.sum("c").alias("fits"))
    return per.join(n, group).where((F.col("fits") >= share * F.col("n_members")) & (F.col("n_skeletons") >= 2)).select(group, "n_members", "n_skeletons")


def variable_index(fields: DataFrame, cohort: str, name: str, question: str, data_type: str, encoding: str, least: int = 3, labels: int = 8) -> DataFrame:
    """(concept_id, concept, answer_text, option_label): every variable as a concept to match, and each option of a checklist besides.

    A checklist lets several answers be given (its type says multiple, checkbox or
    multi-select) and has ``least`` options or more.
    """
    said = F.filter(vx.parse_options(F.coalesce(encoding, F.lit(""))), lambda o: ~tx.is_sentinel(o["label"]) & ~o["code"].rlike("^-[0-9]+$"))
    q = F.trim(F.coalesce(question, F.lit("")))
    concept = F.when((q != "") & (F.lower(q) != F.lower(name)), F.concat(name, F.lit(" - "), q)).otherwise(F.col(name))
    t = fields.where(F.col(name).isNotNull()).select(F.concat_ws(":", cohort, name).alias("id"), concept.alias("concept"), F.col(name).alias("n"), F.transform(said, lambda o: o["label"]).alias("ls"), F.lower(F.coalesce(data_type, F.lit(""))).alias("k"))
    own = t.select(F.col("id").alias("concept_id"), "concept", F.array_join(F.slice("ls", 1, labels), "; ").alias("answer_text"), F.lit(None).cast("string").alias("option_label"))
    lists = t.where(F.col("k").rlike("multiple|checkbox|multi-?select") & (F.size("ls") >= least)).select("id", "n", F.explode(F.array_distinct("ls")).alias("l"))
    return own.unionByName(lists.select(F.concat("id", F.lit("#opt="), "l").alias("concept_id"), F.concat("n", F.lit(" - "), "l").alias("concept"), F.col("l").alias("answer_text"), F.col("l").alias("option_label")))
