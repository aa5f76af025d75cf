"""Operators on dictionary tables: preparation of fields, names, families, hierarchy, coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text as tx
from fieldloom.functions import values as vx
from fieldloom.runtime import broadcast_if_small, stage, unstage


def latest_deliveries(fields: DataFrame) -> DataFrame:
    """The last delivery of each variable of a cohort (latest load, then largest row id)."""
    w = Window.partitionBy("cohort", "variable_name").orderBy(F.desc_nulls_last("loaded_at"), F.desc("row_id"))
    return fields.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def placeholder_descriptions(fields: DataFrame, least: int = 10) -> DataFrame:
    """Descriptions that ``least`` fields of a cohort share word for word become the words of the variable's name."""
    often = fields.where("description is not null").groupBy("cohort", "description").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("cohort", "description", F.lit(True).alias("_often"))
    words = F.array_join(tx.words_of_name(F.col("variable_name")), " ")
    # A description of a tenth of the rows is rare in number: the counted side is small where it matters.
    marked = fields.join(broadcast_if_small(stage(often, "often")), ["cohort", "description"], "left")
    return marked.withColumn("description", F.when(F.col("_often"), words).otherwise(F.col("description"))).select(*fields.columns)


def common_prefix(fields: DataFrame, ratio: float = 0.5, least_length: int = 8) -> DataFrame:
    """(cohort, prefix, depth, n_fields): the longest run of leading name parts that at least max(2, ratio * fields) of a cohort share.

    It is no deeper than the shortest name of the cohort; equal counts go by text.
    """
    parts = fields.select("cohort", tx.words_of_name(F.col("variable_name")).alias("p"))
    size = parts.groupBy("cohort").agg(F.count("*").alias("n"), F.min(F.greatest(F.size("p"), F.lit(0))).alias("least"))
    each = parts.join(size, "cohort").where("least > 0").select("cohort", "n", F.explode(F.expr("sequence(1, least)")).alias("depth"), "p")
    shared = each.withColumn("prefix", F.array_join(F.slice("p", 1, F.col("depth")), "_")).groupBy("cohort", "depth", "prefix").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    top = Window.partitionBy("cohort").orderBy(F.desc("depth"), F.desc("c"), "prefix")
    fit = shared.where(F.col("c") >= F.greatest(F.lit(2), F.floor(F.col("n") * ratio)))
    return fit.withColumn("k", F.row_number().over(top)).where("k = 1").where(F.length("prefix") >= least_length).select("cohort", "prefix", "depth", F.col("c").alias("n_fields"))


def without_prefix(name: Column, prefix: Column, depth: Column) -> Column:
    """``name`` without its first ``depth`` parts, where they are ``prefix`` and something is left; null prefixes keep it."""
    parts = tx.words_of_name(name)
    signs = F.length(F.replace(prefix, F.lit("_"), F.lit("")))
    rest = F.regexp_replace(name, F.concat(F.lit("^(?:[^A-Za-z0-9]*[A-Za-z0-9]){"), signs.cast("string"), F.lit("}[_.-]*")), F.lit(""))
    fits = (F.size(parts) > depth) & (F.array_join(F.slice(parts, 1, F.greatest(depth, F.lit(1))), "_") == prefix)
    return F.when(F.coalesce(fits, F.lit(False)) & (rest != ""), rest).otherwise(name)


def without_stopwords(name: Column, words: list[str]) -> Column:
    """``name`` without the given pieces of text, whatever their case; a name that would be empty stays."""
    if not words:
        return name
    t = F.regexp_replace(name, "(?i)" + "|".join(re.escape(w) for w in words), "")
    t = F.regexp_replace(F.regexp_replace(t, r"([_.-])[_.-]+", "$1"), r"^[_.\- ]+|[_.\- ]+$", "")
    return F.when(t != "", t).otherwise(name)


def distinct_names(fields: DataFrame, name: str = "variable_name") -> DataFrame:
    """``unique_name``: the first field of a name in a cohort keeps it, later ones get __2, __3 and so on, by ``ord`` and row id.

    Where a field is already called so, more underscores stand before the number.
    """
    n = F.row_number().over(Window.partitionBy("cohort", name).orderBy("ord", "row_id"))
    out = fields.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(name, F.lit("__"), F.col("_n").cast("string"))))
    late = stage(out.where("_n > 1").select("cohort", "unique_name").intersect(fields.select("cohort", F.col(name).alias("unique_name"))), "clashes")
    if late.isEmpty():
        return out.drop("_n")
    k = F.row_number().over(Window.partitionBy("cohort", "unique_name").orderBy("_n", "ord", "row_id"))
    clash = broadcast_if_small(late.withColumn("_c", F.lit(True)))
    marked = out.join(clash, ["cohort", "unique_name"], "left")
    return marked.withColumn("unique_name", F.when(F.col("_c") & (F.col("_n") > 1), F.concat(name, F.lit("____"), F.col("_n").cast("string"))).otherwise(F.col("unique_name"))).drop("_n", "_c")


#: Steps of the preparation, in order; each can be left out.
STEPS = ("unicode", "administrative", "echo", "placeholders", "prefix", "stopwords", "dedup", "whitespace")


def prepare(fields: DataFrame, steps: tuple[str, ...] = STEPS, stopwords: tuple[str, ...] = (), prefix_length: int = 8, prefix_ratio: float = 0.5, placeholder_least: int = 10) -> DataFrame:
    """``fields`` made ready for embedding, by cohort; the texts as they came are in ``raw_variable_name``, ``raw_description`` and ``raw_question_text``.

    Steps: straight quotes; wrappings of instruments and markup out of descriptions and
    questions; descriptions that only repeat an option cleared; descriptions that many
    fields share replaced by the name; the common prefix of names cut; stop words cut
    from names; ``embed_name`` false where the description says the name; white space.
    At last names that became equal are told apart. ``did_..`` columns say which step
    changed a row. With no steps nothing changes.
    """
    flags = {x: f"did_{x}" for x in STEPS}
    t = fields
    for c in ("variable_name", "description", "question_text"):
        t = t.withColumn(f"raw_{c}", F.col(c))
    changed = lambda *pairs: F.coalesce(F.exists(F.array(*(~a.eqNullSafe(b) for a, b in pairs)), lambda x: x), F.lit(False))
    name, text, ask = F.col("variable_name"), F.col("description"), F.col("question_text")

    def step(t: DataFrame, flag: str, new: dict[str, Column]) -> DataFrame:
        t = t.withColumns({f"_new_{c}": v for c, v in new.items()}).withColumn(flags[flag], changed(*((F.col(c), F.col(f"_new_{c}")) for c in new)))
        return t.withColumns({c: F.col(f"_new_{c}") for c in new}).drop(*(f"_new_{c}" for c in new))

    if "unicode" in steps:
        t = step(t, "unicode", {c: tx.straight_quotes(F.col(c)) for c in ("variable_name", "description", "question_text")})
    if "administrative" in steps:
        t = step(t, "administrative", {c: tx.clean_or_keep(F.col(c)) for c in ("description", "question_text")})
    if "echo" in steps:
        t = step(t, "echo", {"description": F.when(option_echo(text, F.col("value_encoding")), F.lit("")).otherwise(text)})
    if "placeholders" in steps:
        often = t.where("description is not null and trim(description) <> ''").groupBy("cohort", F.trim("description").alias("_d")).agg(F.count("*").alias("_n")).where(F.col("_n") >= placeholder_least).drop("_n")
        t = t.join(often.withColumnRenamed("cohort", "_c").withColumn("_often", F.lit(True)), (F.col("cohort") == F.col("_c")) & (F.trim("description") == F.col("_d")), "left").drop("_c", "_d")
        t = step(t, "placeholders", {"description": F.when(F.col("_often"), F.array_join(tx.words_of_name(name), " ")).otherwise(text)}).drop("_often")
    if "prefix" in steps:
        found = common_prefix(t, prefix_ratio, prefix_length).select(F.col("cohort").alias("_c"), F.col("prefix").alias("_p"), F.col("depth").alias("_k"))
        t = t.join(F.broadcast(found), F.col("cohort") == F.col("_c"), "left").drop("_c")  # a row for each cohort
        t = step(t, "prefix", {"variable_name": without_prefix(name, F.col("_p"), F.col("_k"))}).drop("_p", "_k")
    if "stopwords" in steps and stopwords:
        t = step(t, "stopwords", {"variable_name": without_stopwords(name, list(stopwords))})
    t = t.withColumn("embed_name", ~name_in_description(name, text) if "dedup" in steps else F.lit(True))
    if "dedup" in steps:
        t = t.withColumn(flags["dedup"], ~F.col("embed_name"))
    if "whitespace" in steps:
        t = step(t, "whitespace", {c: tx.squeeze(F.col(c)) for c in ("variable_name", "description", "question_text")})
    t = t.withColumns({f: F.lit(False) for f in flags.values() if f not in t.columns})
    return distinct_names(t).withColumn("variable_name", F.col("unique_name")).drop("unique_name") if steps else t


def preparation_report(prepared: DataFrame) -> DataFrame:
    """(cohort, n_fields, n_.., names_changed, descriptions_changed): how many fields each step of ``prepare`` changed."""
    count = lambda c: F.count(F.when(c, 1))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"raw_{c}"))
    return prepared.groupBy("cohort").agg(F.count("*").alias("n_fields"), *(count(F.col(f"did_{x}")).alias(f"n_{x}") for x in STEPS), count(differs("variable_name")).alias("names_changed"), count(differs("description")).alias("descriptions_changed"))


def embedding_text(question: Column, description: Column, name: Column, category: Column) -> Column:
    base = F.coalesce(F.nullif(F.trim(question), F.lit("")), F.nullif(F.trim(description), F.lit("")), name)
    return F.concat_ws(" | ", base, F.nullif(F.trim(category), F.lit("")))


def value_text(encoding: Column, data_type: Column, units: Column) -> Column:
    labels = F.array_join(F.transform(vx.parse_options(F.coalesce(encoding, F.lit(""))), lambda o: o["label"]), "; ")
    return F.concat_ws(" | ", F.nullif(labels, F.lit("")), F.nullif(F.trim(data_type), F.lit("")), F.nullif(F.trim(units), F.lit("")))


def name_in_description(name: Column, description: Column) -> Column:
    """Whether a description holds the name with its separators as blanks."""
    words = F.trim(F.lower(F.translate(name, "_.-", "   ")))
    return F.coalesce(F.contains(F.lower(description), words) & (words != ""), F.lit(False))


def option_echo(description: Column, encoding: Column) -> Column:
    """Whether a description only repeats one of its own options, in quotes or not."""
    labels = F.transform(vx.parse_options(F.coalesce(encoding, F.lit(""))), lambda o: F.lower(o["label"]))
    said = F.lower(F.trim(F.regexp_replace(F.trim(description), "^[\"']+|[\"']+$", "")))
    return F.coalesce(F.array_contains(labels, said) & (said != ""), F.lit(False))


def coverage(fields: DataFrame, group: str, cohort: str) -> DataFrame:
    """(group, n_members, n_cohorts, top_cohort, missing_cohorts): which cohorts a group has, and which it lacks."""
    per = fields.where(F.col(group).isNotNull()).groupBy(group, cohort).agg(F.count("*").alias("n"))
    everyone = fields.select(cohort).distinct().agg(F.array_sort(F.collect_set(cohort)).alias("everyone"))
    g = per.groupBy(group).agg(F.sum("n").alias("n_members"), F.count("*").alias("n_cohorts"), F.max(F.struct(F.col("n"), F.col(cohort).alias("c")))["c"].alias("top_cohort"), F.collect_set(cohort).alias("have"))
    missing = F.array_join(F.array_except("everyone", "have"), ",")
    return g.crossJoin(F.broadcast(everyone)).select(group, "n_members", F.col("n_cohorts").cast("long"), "top_cohort", missing.alias("missing_cohorts"))  # one row


def label_words(rows: DataFrame, group: str, text: str, top: int = 3, least: int = 3, stop: tuple[str, ...] = ("the", "and", "for", "was", "what", "how", "your", "you", "did", "with")) -> DataFrame:
    """(group, label): the ``top`` most frequent words of a group's texts, by count then word."""
    words = rows.where(F.col(group).isNotNull()).select(group, F.explode(tx.tokens(F.col(text), least)).alias("word")).where(~F.col("word").isin(*stop))
    counts = words.groupBy(group, "word").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "word"))
    best = counts.withColumn("k", k).where(F.col("k") <= top)
    return best.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("label"))


def positional_families(rows: DataFrame, group: str, label: str, share: float = 0.7, least: int = 4, density: float = 0.5) -> DataFrame:
    """Groups whose labels are one wording with running numbers: (group, signature, share, n_numbers, density). All numbers of a label count."""
    sig = rows.where(F.col(label).isNotNull()).select(group, tx.signature(F.col(label)).alias("sig"), F.transform(F.regexp_extract_all(F.col(label), F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("long")).alias("nums"))
    count = sig.groupBy(group, "sig").agg(F.count("*").alias("n"))
    spread = sig.select(group, "sig", F.explode("nums").alias("num")).groupBy(group, "sig").agg(F.count_distinct("num").alias("n_numbers"), F.min("num").alias("lo"), F.max("num").alias("hi"))
    per = count.join(spread, [group, "sig"])
    total = sig.groupBy(group).agg(F.count("*").alias("total"))
    top = per.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "sig"))).where("k = 1")
    out = top.join(total, group).where(F.col("sig").contains("#")).withColumn("share", F.col("n") / F.col("total")).withColumn("density", F.col("n_numbers") / (F.col("hi") - F.col("lo") + 1))
    return out.where((F.col("share") >= share) & (F.col("n_numbers") >= least) & (F.col("density") >= density)).select(group, F.col("sig").alias("signature"), F.round("share", 6).alias("share"), "n_numbers", F.round("density", 6).alias("density"))


def hierarchy(fields: DataFrame, key: str, scope: str, text: str, delimiter: str, levels: int = 5) -> DataFrame:
    """(key, level, parent_name, suffix): texts split at their delimiter while at least two of a scope share the part before it.

    Parents are synthetic: a name from the hash of the whole path.
    """
    cut = "\\" + delimiter if delimiter in "\\|.^$*+?()[]{}" else delimiter
    live = fields.where(F.col(text).isNotNull()).select(key, scope, F.col(text).alias("rest"), F.lit("").alias("path"))
    out = None
    for level in range(1, levels + 1):
        p = F.split("rest", cut, 2)
        split = live.where(F.size(p) > 1).select(key, scope, F.concat("path", F.lit("\\"), F.trim(p[0])).alias("path"), F.trim(p[1]).alias("rest"))
        n = F.count("*").over(Window.partitionBy(scope, "path"))
        kept = split.withColumn("n", n).where("n >= 2").drop("n")
        step = kept.select(key, F.lit(level).alias("level"), F.concat(F.lit("_SYNTHETIC_"), F.substring(F.sha2(F.concat_ws("\\", scope, "path"), 256), 1, 8)).alias("parent_name"), F.col("rest").alias("suffix"))
        out = step if out is None else out.unionByName(step)
        live = kept
    return out


def closure(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(ancestor, descendant): every node and all below it, itself too; cycles end."""
    e = edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(parent).alias("p"), F.col(child).alias("c")).distinct()
    nodes = e.select(F.col("p").alias("x")).union(e.select("c")).distinct()
    reached = [stage(nodes.select(F.col("x").alias("ancestor"), F.col("x").alias("descendant")), "closure")]
    while True:
        step = reached[-1].join(e, F.col("descendant") == F.col("p")).select("ancestor", F.col("c").alias("descendant")).distinct()
        for seen in reached:  # each frontier is written once and never again
            step = step.join(seen, ["ancestor", "descendant"], "left_anti")
        frontier = stage(step, "frontier")
        if frontier.isEmpty():
            unstage(frontier)
            break
        reached.append(frontier)
    out = reached[0]
    for frontier in reached[1:]:
        out = out.unionByName(frontier)
    return out


def set_digests(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, set_id): an id of the set of a group's distinct keys, whatever their order.

    Keys are digested in 4,096 buckets of their hash, then the buckets, so that no task
    holds all keys of a group.
    """
    keys = rows.where(F.col(key).isNotNull()).select(group, F.col(key).cast("string").alias("k")).distinct().withColumn("b", F.substring(F.md5("k"), 1, 3))
    bucket = keys.groupBy(group, "b").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("k")), "\u001f")).alias("s"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda x: x["s"]), "\u001f")
    return bucket.groupBy(group).agg(F.concat(F.lit("c"), F.substring(F.sha1(every), 1, 12)).alias("set_id"))


def encoding_rollup(rows: DataFrame, key: str, code: str, label: str, order: str, cap: int) -> DataFrame:
    """(key, n, value_encoding): code=label of each key in order; only for at most ``cap`` entries."""
    pairs = rows.where(F.col(key).isNotNull()).groupBy(key, code, label).agg(F.min(order).alias("o"))
    n = pairs.groupBy(key).agg(F.count("*").alias("n"))
    few = pairs.join(n.where(F.col("n") <= cap), key)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", code, label))), lambda x: F.concat(x[code], F.lit("="), x[label])), "|")
    return few.groupBy(key).agg(F.max("n").alias("n"), text.alias("value_encoding"))


#: Header patterns of each role with their scores (fixed values).
ROLES = {
    "variable_name": {"variable_name": 1.0, "column_name": 0.95, "field_name": 0.95, "historical_id": 0.9, "var_name": 0.9, "name": 0.6},
    "field_id": {"field_id": 1.0, "fieldid": 1.0, "dataset_id": 0.9, "variable_id": 0.9, "cde_id": 0.95, "id": 0.4},
    "description": {"description": 1.0, "phenotype_description": 1.0, "field_description": 0.95, "definition": 0.9, "label": 0.7, "field": 0.6},
    "short_label": {"short_label": 1.0, "field_string": 0.9, "field_label": 0.9, "display_name": 0.9, "title": 0.6},
    "data_type": {"data_type": 1.0, "valuetype": 1.0, "value_type": 1.0, "field_type": 0.95, "variable_type": 0.9, "data_type_pandas": 0.8, "type": 0.7, "itemtype": 0.7},
    "units": {"units": 1.0, "unit_of_measure": 1.0, "unit": 0.9, "measurement_unit": 0.9, "uom": 0.8},
    "category": {"category": 1.0, "section": 0.95, "domain": 0.8, "form_name": 0.85, "parent_category": 0.8, "subcategory": 0.7, "path": 0.6, "group": 0.5},
    "value_encoding": {"value_encoding": 1.0, "data_coding": 0.95, "permissible_values": 1.0, "allowed_values": 0.95, "choices": 0.9, "response_options": 1.0, "options": 0.7, "values": 0.6, "codelist": 0.8},
    "standard_code": {"snomed": 0.95, "loinc": 0.95, "omop": 0.95, "concept_id": 0.9, "coding": 0.5},
    "parent_id": {"parent_id": 1.0, "parent_field": 0.9, "parent": 0.6},
    "question_text": {"question_text": 1.0, "question": 0.8, "prompt": 0.7, "field_note": 0.6},
    "validation": {"validation": 1.0, "text_validation": 0.95, "input_restriction": 0.9, "min_value": 0.7, "max_value": 0.7, "format": 0.5},
}


#: A header that is no pattern but plain enough: the bare word for a variable.
BARE = {"variable": ("variable_name", 0.9)}


def detect_roles(columns: list[str], hints: dict[str, str] | None = None) -> dict[str, str]:
    """Role to column: hints first, then the best scored pair of a free role and column, and so on; equal scores by place."""
    taken = dict(hints or {})
    scored = []
    for at, column in enumerate(columns):
        name = re.sub("[^a-z0-9]+", "_", column.strip().lower())
        for role, patterns in ROLES.items():
            score = max((x + (0.1 if name == p else 0.0) for p, x in patterns.items() if p in name), default=0.0)
            if name in BARE and BARE[name][0] == role:
                score = max(score, BARE[name][1])
            if score > 0:
                scored.append((-score, at, role, column))
    for _, _, role, column in sorted(scored):
        if role not in taken and column not in taken.values():
            taken[role] = column
    return taken


def role_scores(headers: DataFrame) -> DataFrame:
    """(file_name, column_name, role, score): each column against each role by substring, 0.1 more where equal; zero scores left out."""
    cols = headers.select("file_name", F.explode(F.expr("split(header, concat('[', delimiter, ']'))")).alias("column_name")).withColumn("c", F.regexp_replace(F.lower(F.trim("column_name")), "[^a-z0-9]+", "_"))
    out = None
    for role, patterns in ROLES.items():
        best = F.greatest(*(F.when(F.contains(F.col("c"), F.lit(p)), F.lit(x) + F.when(F.col("c") == p, F.lit(0.1)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0)) for p, x in patterns.items()))
        one = cols.select("file_name", "column_name", F.lit(role).alias("role"), F.round(best, 2).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.where("score > 0")
