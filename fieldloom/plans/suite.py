"""Queries of the harmonization operators over whole tables, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text as tx
from fieldloom.functions import values as vx
from fieldloom.operators import dictionary as dx
from fieldloom.operators import families as fx
from fieldloom.operators import groups as gx
from fieldloom.operators import reports as rp
from fieldloom.operators import retrieval as rx
from fieldloom.operators.graph import connected_components
from fieldloom.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- preparation of texts and names -----------------------------------------------------------------------------------

_SQ = r"trim(regexp_replace({0}, '[\s\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
_NA = ", ".join(f"'{t}'" for t in tx.NA_TOKENS)
_WORDS = r"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"SELECT row_id, {_SQ.format('description')} AS description, {_SQ.format('question_text')} AS question_text FROM dictionary_fields")
def squeeze_whitespace(spark, d):
    t = table(spark, d, "dictionary_fields")
    return t.select("row_id", tx.squeeze(F.col("description")).alias("description"), tx.squeeze(F.col("question_text")).alias("question_text"))


@query(f"""SELECT row_id, CASE WHEN trim(category) IN ({_NA}) THEN NULL ELSE trim(category) END AS category,
 CASE WHEN trim(units) IN ({_NA}) THEN NULL ELSE trim(units) END AS units,
 coalesce(CASE WHEN trim(question_text) IN ({_NA}) THEN NULL ELSE trim(question_text) END, CASE WHEN trim(description) IN ({_NA}) THEN NULL ELSE trim(description) END, CASE WHEN trim(variable_name) IN ({_NA}) THEN NULL ELSE trim(variable_name) END) AS shown
 FROM dictionary_fields""")
def na_cells(spark, d):
    t = table(spark, d, "dictionary_fields")
    return t.select("row_id", tx.null_if_na(F.col("category")).alias("category"), tx.null_if_na(F.col("units")).alias("units"), tx.first_value(F.col("question_text"), F.col("description"), F.col("variable_name")).alias("shown"))


_TAG = rf"regexp_replace(regexp_replace({{0}}, '(?is)<(?:script|style|head)\b[^>]*>.*?</(?:script|style|head)>', ' ', 'g'), '(?i)</?(?:{tx.TAGS})\b[^>]*>', ' ', 'g')"
_ENT = "{0}"
for _e, _c in tx.ENTITIES.items():
    _ENT = f"replace({_ENT}, '{_e}', '{_c if _c != chr(39) else chr(39) * 2}')"
_PRE, _QUO = (x.replace("'", "''") for x in (tx.PREAMBLE, tx.QUOTED))
_SENT = f"(regexp_matches(lower(trim({{0}})), '{tx.SENTINEL.replace(chr(39), chr(39) * 2)}') OR trim({{0}}) = '')"
_LABEL = "trim(CASE WHEN contains({0}, '=') THEN regexp_replace({0}, '^[^=]*=', '') WHEN contains({0}, ',') THEN regexp_replace({0}, '^[^,]*,', '') ELSE {0} END)"
_MARKUP = "'ACE touchscreen question: \"' || replace(question_text, ' in ', ' <b>in</b>&nbsp;') || '\"<br>Select one &amp; go on'"


@query(f"""WITH m AS (SELECT row_id, {_ENT.format(f"CASE WHEN row_id % 3 = 0 THEN coalesce(question_text, '') ELSE coalesce({_MARKUP}, '') END")} AS t FROM dictionary_fields),
 q AS (SELECT row_id, CASE WHEN regexp_matches(t, '{_PRE}') THEN regexp_extract(t, '{_PRE}', 1) WHEN regexp_matches(t, '{_QUO}') THEN regexp_extract(t, '{_QUO}', 1) ELSE t END AS t FROM m)
 SELECT row_id, {_SQ.format(_TAG.format('t'))} AS cleaned FROM q""")
def clean_field_text(spark, d):
    t = table(spark, d, "dictionary_fields")
    marked = F.concat(F.lit('ACE touchscreen question: "'), F.replace("question_text", F.lit(" in "), F.lit(" <b>in</b>&nbsp;")), F.lit('"<br>Select one &amp; go on'))
    return t.select("row_id", tx.clean(F.when(F.col("row_id") % 3 == 0, F.col("question_text")).otherwise(marked)).alias("cleaned"))


@query(f"SELECT row_id, list_aggregate({_WORDS.format('variable_name')}, 'string_agg', ' ') AS words, CAST(len({_WORDS.format('variable_name')}) AS INTEGER) AS n_words FROM dictionary_fields")
def split_identifier(spark, d):
    w = tx.words_of_name(F.col("variable_name"))
    return table(spark, d, "dictionary_fields").select("row_id", F.array_join(w, " ").alias("words"), F.size(w).alias("n_words"))


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort, variable_name ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn_ FROM dictionary_fields) WHERE rn_ = 1)"


@query(f"SELECT row_id, cohort, variable_name FROM {_LATEST}")
def latest_deliveries(spark, d):
    return dx.latest_deliveries(table(spark, d, "dictionary_fields")).select("row_id", "cohort", "variable_name")


@query(f"""SELECT row_id, CASE WHEN description IS NOT NULL AND count(*) OVER (PARTITION BY cohort, description) >= 3
 THEN list_aggregate({_WORDS.format('variable_name')}, 'string_agg', ' ') ELSE description END AS description FROM dictionary_fields""")
def placeholder_replace(spark, d):
    return dx.placeholder_descriptions(table(spark, d, "dictionary_fields"), 3).select("row_id", "description")


@query(f"""WITH p AS (SELECT cohort, {_WORDS.format('variable_name')} AS p FROM dictionary_fields),
 n AS (SELECT cohort, count(*) AS n, min(coalesce(len(p), 0)) AS least FROM p GROUP BY cohort),
 e AS (SELECT p.cohort, n, p, unnest(range(1, least + 1)) AS depth FROM p JOIN n USING (cohort)),
 s AS (SELECT cohort, n, depth, list_aggregate(p[1:depth], 'string_agg', '_') AS prefix, count(*) AS c FROM e GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY depth DESC, c DESC, prefix) AS k FROM s WHERE c >= greatest(2, floor(n * 0.02)))
 SELECT cohort, prefix, CAST(depth AS INTEGER) AS depth, c AS n_fields FROM k WHERE k = 1 AND length(prefix) >= 1""")
def common_prefix(spark, d):
    return dx.common_prefix(table(spark, d, "dictionary_fields"), 0.02, 1)


@query("""WITH n AS (SELECT row_id, cohort, variable_name, row_number() OVER (PARTITION BY cohort, variable_name ORDER BY ord, row_id) AS n FROM dictionary_fields), taken AS (SELECT DISTINCT cohort, variable_name FROM dictionary_fields)
 SELECT n.row_id, CASE WHEN n = 1 THEN n.variable_name WHEN t.cohort IS NULL THEN n.variable_name || '__' || n ELSE n.variable_name || '____' || n END AS unique_name FROM n LEFT JOIN taken t ON n.cohort = t.cohort AND t.variable_name = n.variable_name || '__' || n.n""")
def disambiguate_names(spark, d):
    return dx.distinct_names(table(spark, d, "dictionary_fields")).select("row_id", "unique_name")


@query("SELECT row_id, coalesce(contains(lower(description), trim(lower(translate(variable_name, '_.-', '   ')))) AND trim(translate(variable_name, '_.-', '   ')) <> '', false) AS name_in_description FROM dictionary_fields")
def name_dedup(spark, d):
    return table(spark, d, "dictionary_fields").select("row_id", dx.name_in_description(F.col("variable_name"), F.col("description")).alias("name_in_description"))


@query("""SELECT row_id, concat_ws(' | ', coalesce(nullif(trim(question_text), ''), nullif(trim(description), ''), variable_name), nullif(trim(category), '')) AS embedding_text,
 substr(sha256(concat_ws(' | ', coalesce(nullif(trim(question_text), ''), nullif(trim(description), ''), variable_name), nullif(trim(category), ''))), 1, 16) AS content_hash FROM dictionary_fields""")
def embedding_texts(spark, d):
    t = dx.embedding_text(F.col("question_text"), F.col("description"), F.col("variable_name"), F.col("category"))
    return table(spark, d, "dictionary_fields").select("row_id", t.alias("embedding_text"), tx.short_hash(t).alias("content_hash"))


@query(f"""SELECT row_id, nullif(list_aggregate(list_filter(list_transform(string_split(value_encoding, '|'), lambda p: trim(p)), lambda p: NOT {_SENT.format(_LABEL.format('p'))}), 'string_agg', '|'), '') AS stripped
 FROM dictionary_fields WHERE value_encoding IS NOT NULL""")
def strip_sentinels(spark, d):
    t = table(spark, d, "dictionary_fields").where("value_encoding is not null")
    return t.select("row_id", tx.strip_sentinels(F.col("value_encoding")).alias("stripped"))


@query("SELECT signature, count(*) AS n, min(row_id) AS first_row FROM (SELECT row_id, trim(regexp_replace(regexp_replace(lower(description), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g')) AS signature FROM dictionary_fields WHERE description IS NOT NULL) GROUP BY signature")
def signatures(spark, d):
    t = table(spark, d, "dictionary_fields").where("description is not null").select("row_id", tx.signature(F.col("description")).alias("signature"))
    return t.groupBy("signature").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query("""WITH k AS (SELECT DISTINCT cohort, variable_name AS k, substr(md5(variable_name), 1, 3) AS b FROM dictionary_fields WHERE variable_name IS NOT NULL),
 s AS (SELECT cohort, b, sha1(string_agg(k, chr(31) ORDER BY k)) AS s FROM k GROUP BY ALL)
 SELECT cohort, 'c' || substr(sha1(string_agg(s, chr(31) ORDER BY b)), 1, 12) AS set_id, substr(sha1(cohort || chr(31) || 'fields'), 1, 12) AS token FROM s GROUP BY cohort""")
def content_ids(spark, d):
    t = dx.set_digests(table(spark, d, "dictionary_fields"), "cohort", "variable_name")
    return t.select("cohort", "set_id", tx.ordered_id(F.col("cohort"), F.lit("fields")).alias("token"))


@query(f"""SELECT row_id, regexp_matches(lower(concat_ws(' ', question_text, description)), '{tx.OPEN_TEXT}') OR coalesce(regexp_matches(lower(variable_name), '{tx.OPEN_TEXT}'), false)
 OR (lower(trim(coalesce(data_type, ''))) IN ({", ".join(f"'{t}'" for t in tx.TEXT_TYPES)}) AND coalesce(n_codes, 0) = 0) AS free_text FROM dictionary_fields""")
def free_text_flags(spark, d):
    free = tx.looks_free_text(F.col("question_text"), F.col("description"), F.col("variable_name"), F.col("data_type"), F.col("n_codes"))
    return table(spark, d, "dictionary_fields").select("row_id", free.alias("free_text"))


# --- roles, lookups, hierarchy ---------------------------------------------------------------------------------------


def _role_sql() -> str:
    arms = []
    for role, patterns in dx.ROLES.items():
        parts = ", ".join(f"CASE WHEN contains(c, '{p}') THEN {x} + CASE WHEN c = '{p}' THEN 0.1 ELSE 0 END ELSE 0 END" for p, x in patterns.items())
        arms.append(f"SELECT file_name, column_name, '{role}' AS role, CAST(round(greatest({parts}), 2) AS DOUBLE) AS score FROM cols")
    return "WITH cols AS (SELECT file_name, column_name, regexp_replace(lower(trim(column_name)), '[^a-z0-9]+', '_', 'g') AS c FROM (SELECT file_name, unnest(string_split(header, delimiter)) AS column_name FROM raw_files)) SELECT * FROM (" + " UNION ALL ".join(arms) + ") WHERE score > 0"


@query(_role_sql())
def role_scores(spark, d):
    return dx.role_scores(table(spark, d, "raw_files"))


@query("""SELECT coalesce(d.dictionary_name, f.dictionary_name) AS dictionary_name, d.title, f.file_name, CAST(f.n_columns AS INTEGER) AS n_columns, d.dictionary_name IS NULL AS only_file, f.file_name IS NULL AS only_dictionary
 FROM dictionaries d FULL OUTER JOIN raw_files f ON d.dictionary_name = f.dictionary_name""")
def full_outer_merge(spark, d):
    a, b = table(spark, d, "dictionaries").alias("d"), table(spark, d, "raw_files").alias("f")
    j = a.join(b, F.col("d.dictionary_name") == F.col("f.dictionary_name"), "full")
    return j.select(F.coalesce("d.dictionary_name", "f.dictionary_name").alias("dictionary_name"), "d.title", "f.file_name", F.col("f.n_columns").cast("int").alias("n_columns"), F.col("d.dictionary_name").isNull().alias("only_file"), F.col("f.file_name").isNull().alias("only_dictionary"))


@query("""SELECT f.row_id, d.title, d.lang, CAST(d.n_waves AS INTEGER) AS n_waves, d.steward_org FROM dictionary_fields f LEFT JOIN dictionaries d ON f.cohort = d.dictionary_name""")
def field_lookup(spark, d):
    f, k = table(spark, d, "dictionary_fields").select("row_id", "cohort"), table(spark, d, "dictionaries")
    return f.join(k, f["cohort"] == k["dictionary_name"], "left").select("row_id", "title", "lang", F.col("n_waves").cast("int").alias("n_waves"), "steward_org")


@query("""WITH p AS (SELECT encoding_id, variable_name, category, min(ord) AS o FROM dictionary_fields WHERE encoding_id IS NOT NULL GROUP BY ALL),
 n AS (SELECT encoding_id, count(*) AS n FROM p GROUP BY encoding_id HAVING count(*) <= 400)
 SELECT p.encoding_id, max(n.n) AS n, string_agg(variable_name || '=' || category, '|' ORDER BY o, variable_name, category) AS value_encoding FROM p JOIN n USING (encoding_id) WHERE variable_name || '=' || category IS NOT NULL GROUP BY p.encoding_id""")
def encoding_rollup(spark, d):
    t = table(spark, d, "dictionary_fields")
    full = t.where("variable_name is not null and category is not null")
    n = t.where("encoding_id is not null").groupBy("encoding_id", "variable_name", "category").agg(F.min("ord").alias("o"))
    n = n.groupBy("encoding_id").agg(F.count("*").alias("n")).where("n <= 400")
    out = dx.encoding_rollup(full.join(n.select("encoding_id"), "encoding_id", "left_semi"), "encoding_id", "variable_name", "category", "ord", 400)
    return out.drop("n").join(n, "encoding_id").select("encoding_id", "n", "value_encoding")


@query("""SELECT row_id FROM dictionary_fields f WHERE EXISTS (SELECT 1 FROM cde_catalog c WHERE lower(trim(c.uom)) = lower(trim(f.units)))""")
def select_by_catalog_unit(spark, d):
    f, c = table(spark, d, "dictionary_fields"), table(spark, d, "cde_catalog")
    return f.join(c, F.lower(F.trim(f["units"])) == F.lower(F.trim(c["uom"])), "left_semi").select("row_id")


@query("""SELECT dictionary_name, variable_name FROM (SELECT dictionary_name, variable_name FROM field_vectors EXCEPT SELECT cohort, variable_name FROM dictionary_fields)""")
def vectors_without_fields(spark, d):
    v, f = table(spark, d, "field_vectors"), table(spark, d, "dictionary_fields")
    return v.select("dictionary_name", "variable_name").subtract(f.select("cohort", "variable_name"))


@query("""SELECT dictionary_name FROM field_references INTERSECT SELECT cohort FROM dictionary_fields""")
def dictionaries_in_both(spark, d):
    return table(spark, d, "field_references").select("dictionary_name").intersect(table(spark, d, "dictionary_fields").select("cohort"))


def _tree(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    up = n.select(F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("child"))
    return up.unionByName(c.select(F.concat(F.lit("N"), F.col("c_nationkey")).alias("parent"), F.concat(F.lit("C"), F.col("c_custkey")).alias("child")))


_TREE = "(SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer)"


@query(f"""WITH RECURSIVE e AS {_TREE}, t AS (SELECT x AS ancestor, x AS descendant FROM (SELECT parent AS x FROM e UNION SELECT child FROM e) UNION SELECT t.ancestor, e.child FROM t JOIN e ON t.descendant = e.parent)
 SELECT ancestor, count(*) AS n_below, min(descendant) AS first_below FROM t GROUP BY ancestor""")
def category_closure(spark, d):
    return dx.closure(_tree(spark, d), "parent", "child").groupBy("ancestor").agg(F.count("*").alias("n_below"), F.min("descendant").alias("first_below"))


@query("""WITH a AS (SELECT row_id, cohort, description AS rest, '' AS path FROM dictionary_fields WHERE description IS NOT NULL),
 s1 AS (SELECT row_id, cohort, path || '\\' || trim(split_part(rest, ',', 1), ' ') AS path, trim(substr(rest, strpos(rest, ',') + 1), ' ') AS rest FROM a WHERE contains(rest, ',')),
 l1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY cohort, path) AS n FROM s1) WHERE n >= 2),
 s2 AS (SELECT row_id, cohort, path || '\\' || trim(split_part(rest, ',', 1), ' ') AS path, trim(substr(rest, strpos(rest, ',') + 1), ' ') AS rest FROM l1 WHERE contains(rest, ',')),
 l2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY cohort, path) AS n FROM s2) WHERE n >= 2),
 u AS (SELECT row_id, 1 AS level, cohort, path, rest FROM l1 UNION ALL SELECT row_id, 2, cohort, path, rest FROM l2)
 SELECT row_id, CAST(level AS INTEGER) AS level, '_SYNTHETIC_' || substr(sha256(concat_ws('\\', cohort, path)), 1, 8) AS parent_name, rest AS suffix FROM u""")
def hierarchy_children(spark, d):
    return dx.hierarchy(table(spark, d, "dictionary_fields"), "row_id", "cohort", "description", ",", 2)


@query()
def hierarchy_levels(spark, d):
    """All five levels; the SQL of hierarchy_children spells out two."""
    return dx.hierarchy(table(spark, d, "dictionary_fields"), "row_id", "cohort", "description", ",")


# --- value domains -----------------------------------------------------------------------------------------------------

_PARTS = "list_filter(list_transform(string_split(trim(value_encoding), '|'), lambda p: trim(p)), lambda p: p <> '')"
_OPTIONS = f"""WITH r AS (SELECT row_id, trim(value_encoding) AS raw, {_PARTS} AS ps FROM dictionary_fields WHERE value_encoding IS NOT NULL),
 f AS (SELECT row_id, raw, ps,
  list_filter(list_transform(ps, lambda p: {{'code': trim(regexp_extract(p, '^\\(([^()]*)\\)', 1)), 'label': trim(regexp_replace(p, '^\\([^()]*\\)', ''))}}), lambda o: o.code <> '' AND o.label <> '') AS a,
  list_filter(list_transform(ps, lambda p: {{'code': trim(split_part(p, '=', 1)), 'label': trim(regexp_replace(p, '^[^=]*=', ''))}}), lambda o: o.code <> '' AND o.label <> '') AS b,
  list_filter(list_transform(ps, lambda p: {{'code': trim(split_part(p, ',', 1)), 'label': trim(regexp_replace(p, '^[^,]*,', ''))}}), lambda o: o.code <> '' AND o.label <> '') AS c,
  string_split(raw, '/') AS sl FROM r),
 o AS (SELECT row_id, CASE
  WHEN len(list_filter(ps, lambda p: NOT regexp_matches(p, '^\\([^()]*\\)'))) = 0 AND len(a) >= 2 THEN a
  WHEN len(list_filter(ps, lambda p: NOT contains(p, '='))) = 0 AND len(b) >= 2 THEN b
  WHEN len(list_filter(ps, lambda p: NOT regexp_matches(p, '^[A-Za-z0-9_-]*[0-9_][A-Za-z0-9_-]*,'))) = 0 AND len(c) >= 2 THEN c
  WHEN len(ps) >= 2 THEN list_transform(ps, lambda p, i: {{'code': CAST(i AS VARCHAR), 'label': trim(p)}})
  WHEN len(ps) = 1 AND len(sl) BETWEEN 2 AND 3 AND len(list_filter(sl, lambda p: NOT (length(trim(p)) <= 20 AND regexp_matches(trim(p), '^[A-Z][A-Za-z ]+$')))) = 0 THEN list_transform(sl, lambda p, i: {{'code': CAST(i AS VARCHAR), 'label': trim(p)}})
  ELSE [] END AS opts FROM f)"""


@query(f"{_OPTIONS} SELECT row_id, CAST(i AS INTEGER) AS pos, opts[i].code AS code, opts[i].label AS label FROM (SELECT row_id, opts, unnest(range(1, len(opts) + 1)) AS i FROM o)")
def parse_options(spark, d):
    t = table(spark, d, "dictionary_fields").where("value_encoding is not null")
    e = t.select("row_id", F.posexplode(vx.parse_options(F.col("value_encoding"))).alias("pos", "o"))
    return e.select("row_id", (F.col("pos") + 1).alias("pos"), "o.code", "o.label")


@query(f"{_OPTIONS} SELECT d.row_id, CAST(len(o.opts) AS INTEGER) AS parsed, CAST(d.n_codes AS INTEGER) AS stated FROM o JOIN dictionary_fields d USING (row_id) WHERE d.n_codes IS NOT NULL AND d.n_codes <> len(o.opts)")
def wrong_code_counts(spark, d):
    t = table(spark, d, "dictionary_fields").where("value_encoding is not null and n_codes is not null")
    n = F.size(vx.parse_options(F.col("value_encoding")))
    return t.where(n != F.col("n_codes")).select("row_id", n.alias("parsed"), F.col("n_codes").cast("int").alias("stated"))


_UNIT_ROWS = ", ".join(f"('{s}', '{f}', '{u}', {x!r}::DOUBLE, {o!r}::DOUBLE)" for s, f, u, x, o in vx.UNITS)
_UKEY = "regexp_replace(" + "replace(" * len(vx.UNIT_SIGNS) + "lower(trim({0}))" + "".join(f", '{a}', '{b}')" for a, b in vx.UNIT_SIGNS.items()) + r", '[\s.]+', '', 'g')"
_UNITS = f"u(spelling, family, unit, factor, base_offset) AS (VALUES {_UNIT_ROWS})"


@query(f"WITH {_UNITS} SELECT row_id, family, unit AS canonical, factor FROM dictionary_fields f LEFT JOIN u ON {_UKEY.format('f.units')} = u.spelling")
def canonical_units(spark, d):
    return vx.canonical_units(table(spark, d, "dictionary_fields"), "units").select("row_id", "family", "canonical", "factor")


@query(f"""WITH {_UNITS}, x AS (SELECT DISTINCT units FROM dictionary_fields WHERE units IS NOT NULL)
 SELECT a.units AS source_unit, b.units AS target_unit, CASE WHEN abs(ua.factor / ub.factor) < 1e6 THEN round(ua.factor / ub.factor, 10) ELSE round(ua.factor / ub.factor, 2) END AS factor, CASE WHEN abs((ua.base_offset - ub.base_offset) / ub.factor) < 1e6 THEN round((ua.base_offset - ub.base_offset) / ub.factor, 10) ELSE round((ua.base_offset - ub.base_offset) / ub.factor, 2) END AS base_offset,
 abs(round(ua.factor / ub.factor, 10) - 1) <= 1e-9 AND abs(round((ua.base_offset - ub.base_offset) / ub.factor, 10)) <= 1e-9 AS identity
 FROM x a JOIN u ua ON {_UKEY.format('a.units')} = ua.spelling JOIN u ub ON ua.family = ub.family JOIN x b ON {_UKEY.format('b.units')} = ub.spelling""")
def unit_conversions(spark, d):
    x = table(spark, d, "dictionary_fields").where("units is not null").select("units").distinct()
    a, b = vx.canonical_units(x, "units", "a_").where("a_family is not null"), vx.canonical_units(x.withColumnRenamed("units", "target_unit"), "target_unit", "b_").where("b_family is not null")
    factor, offset = vx.conversion((F.col("a_factor"), F.col("a_offset")), (F.col("b_factor"), F.col("b_offset")))
    j = a.join(b, F.col("a_family") == F.col("b_family")).select(F.col("units").alias("source_unit"), "target_unit", factor.alias("factor"), offset.alias("base_offset"))
    return j.withColumn("identity", vx.is_identity(F.col("factor"), F.col("base_offset")))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN NULL WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE o_orderpriority END AS priority,
 CASE WHEN TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) BETWEEN 1 AND 3 THEN 'upper' WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'lower' END AS half FROM orders""")
def recode_apply(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", vx.recode(p, {"1-URGENT,2-HIGH": "high", "3-MEDIUM": "NA", "5-LOW": "low"}, p).alias("priority"), vx.recode(F.substring(p, 1, 1), {"1:3": "upper", "5": "lower"}).alias("half"))


@query("""WITH c AS (SELECT o_orderstatus, count(*) AS n, count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1 END) AS covered FROM orders GROUP BY 1)
 SELECT o_orderstatus, n, round(covered / n, 6) AS coverage, covered / n < 0.8 AS needs_review FROM c""")
def recode_coverage(spark, d):
    hit = F.count(F.when(vx.recode(F.col("o_orderpriority"), {"1-URGENT,2-HIGH": "a", "3-MEDIUM": "b"}).isNotNull(), 1))
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), hit.alias("c"))
    return g.select("o_orderstatus", "n", F.round(F.col("c") / F.col("n"), 6).alias("coverage"), (F.col("c") / F.col("n") < 0.8).alias("needs_review"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) * (1 - l_discount) * (1 + l_tax) AS charge, CAST(l_extendedprice AS DOUBLE) / nullif(CAST(l_quantity AS DOUBLE) - 1, 0) AS per_unit FROM lineitem""")
def formula_eval(spark, d):
    t = table(spark, d, "lineitem")
    names = {"price": F.col("l_extendedprice"), "disc": F.col("l_discount"), "tax": F.col("l_tax"), "q": F.col("l_quantity")}
    return t.select("l_orderkey", "l_linenumber", vx.compile_formula("price * (1 - disc) * (1 + tax)", names).alias("charge"), vx.compile_formula("price / (q - 1)", names).alias("per_unit"))


@query("""SELECT l_returnflag, round(avg(CASE WHEN abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - l_extendedprice * l_discount)) <= greatest(1e-6 * abs(l_extendedprice), 1e-9) THEN 1.0 ELSE 0.0 END), 6) AS right_share,
 round(avg(CASE WHEN abs(l_extendedprice * (1 + l_discount) - (l_extendedprice - l_extendedprice * l_discount)) <= greatest(1e-6 * abs(l_extendedprice), 1e-9) THEN 1.0 ELSE 0.0 END), 6) AS wrong_share FROM lineitem GROUP BY l_returnflag""")
def verify_formula(spark, d):
    t, names = table(spark, d, "lineitem"), {"p": F.col("l_extendedprice"), "d": F.col("l_discount")}
    want = vx.compile_formula("p - p * d", names)
    share = lambda f, c: rp.formula_share(t, "l_returnflag", want, f, names).withColumnRenamed("share", c)
    return share("p * (1 - d)", "right_share").join(share("p * (1 + d)", "wrong_share"), "l_returnflag")


@query("""SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax FROM lineitem)
 UNPIVOT (value FOR measure IN (quantity, discount, tax))""")
def wide_to_long(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax")))
    return t.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "measure", "value")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# --- aggregation --------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT category, cohort, count(*) AS n FROM dictionary_fields WHERE category IS NOT NULL GROUP BY ALL), e AS (SELECT list_sort(list(DISTINCT cohort)) AS everyone FROM dictionary_fields WHERE cohort IS NOT NULL)
 SELECT category, CAST(sum(n) AS BIGINT) AS n_members, count(*) AS n_cohorts, max({'n': n, 'c': cohort}).c AS top_cohort,
 coalesce(list_aggregate(list_filter(any_value(everyone), lambda c: NOT list_contains(list(cohort), c)), 'string_agg', ','), '') AS missing_cohorts FROM p, e GROUP BY category""")
def cluster_coverage(spark, d):
    return dx.coverage(table(spark, d, "dictionary_fields"), "category", "cohort")


_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: length(t) >= {1})"


@query(f"""WITH w AS (SELECT category, unnest({_TOK.format('description', 3)}) AS word FROM dictionary_fields WHERE category IS NOT NULL),
 c AS (SELECT category, word, count(*) AS n FROM w WHERE word NOT IN ('the','and','for','was','what','how','your','you','did','with') GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, word) AS k FROM c)
 SELECT category, string_agg(word, ' ' ORDER BY k) AS label FROM k WHERE k <= 3 GROUP BY category""")
def cluster_labels(spark, d):
    return dx.label_words(table(spark, d, "dictionary_fields"), "category", "description")


@query("""WITH s AS (SELECT o_orderstatus AS g, trim(regexp_replace(regexp_replace(lower(o_clerk), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g')) AS sig, regexp_extract_all(o_clerk, '[0-9]+') AS nums FROM (SELECT o_orderstatus, 'Clerk ' || (o_orderkey % 50) || ' of ' || (o_custkey % 40) AS o_clerk FROM orders)),
 c AS (SELECT g, sig, count(*) AS n FROM s GROUP BY ALL), v AS (SELECT g, sig, count(DISTINCT num) AS k, min(num) AS lo, max(num) AS hi FROM (SELECT g, sig, TRY_CAST(unnest(nums) AS BIGINT) AS num FROM s) GROUP BY ALL), p AS (SELECT * FROM c JOIN v USING (g, sig)), t AS (SELECT g, count(*) AS total FROM s GROUP BY g)
 SELECT p.g, sig AS signature, round(n / total, 6) AS share, k AS n_numbers, round(k / (hi - lo + 1), 6) AS density FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, sig) AS r FROM p) p JOIN t USING (g) WHERE r = 1 AND contains(sig, '#') AND n / total >= 0.7 AND k >= 4 AND k / (hi - lo + 1) >= 0.5""")
def positional_families(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderstatus").alias("g"), F.concat(F.lit("Clerk "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" of "), (F.col("o_custkey") % 40).cast("string")).alias("label"))
    return dx.positional_families(t, "g", "label")


@query(f"""{_OPTIONS}, l AS (SELECT d.category, lower(x.label) AS label, min(d.row_id) AS first_row, count(*) AS n FROM (SELECT row_id, unnest(opts) AS x FROM o) q JOIN dictionary_fields d USING (row_id) WHERE d.category IS NOT NULL
 AND NOT {_SENT.format('x.label')} GROUP BY ALL) SELECT category, label, first_row, n FROM l""")
def observed_labels(spark, d):
    return rp.observed_labels(table(spark, d, "dictionary_fields"), "category", "row_id", "value_encoding")


@query("""WITH g AS (SELECT category, count(DISTINCT cohort) AS n_cohorts, round(avg(CASE WHEN value_encoding IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coded FROM dictionary_fields WHERE category IS NOT NULL GROUP BY category)
 SELECT category, n_cohorts, coded, CASE WHEN n_cohorts < 2 THEN 'single_cohort' WHEN coded >= 0.5 THEN 'harmonize_values' ELSE 'harmonize_text' END AS mode FROM g""")
def gate_mode(spark, d):
    return rp.gate_modes(table(spark, d, "dictionary_fields"), "category", "cohort", "value_encoding")


@query("""SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS tokens, round(sum(value * CASE WHEN event_type IN ('click', 'view') THEN 0.000003 ELSE 0.000015 END * CASE WHEN user_id % 2 = 0 THEN 0.5 ELSE 1 END), 6) AS usd FROM events GROUP BY event_type""")
def cost_ledger(spark, d):
    return rp.cost_ledger(table(spark, d, "events"), "event_type", "value", rp.prices(F.col("event_type"), {"click": 0.000003, "view": 0.000003}, 0.000015), F.col("user_id") % 2 == 0)


@query("""WITH h AS (SELECT DISTINCT user_id, event_type FROM events), c AS (SELECT user_id, count(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 END) AS have FROM h GROUP BY user_id)
 SELECT user_id, have AS n_required, CASE WHEN have = 3 THEN 'full' WHEN have > 0 THEN 'partial' ELSE 'infeasible' END AS feasibility FROM c""")
def feasibility(spark, d):
    need = ["view", "click", "purchase"]
    h = table(spark, d, "events").select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count(F.when(F.col("event_type").isin(need), 1)).alias("n_required"))
    return h.withColumn("feasibility", F.when(F.col("n_required") == len(need), "full").when(F.col("n_required") > 0, "partial").otherwise("infeasible"))


@query("""SELECT category, count(DISTINCT cohort) AS n_cohorts, count(*) AS n_members FROM dictionary_fields WHERE category IS NOT NULL GROUP BY category HAVING count(DISTINCT cohort) >= 2 ORDER BY n_cohorts DESC, n_members DESC, category LIMIT 40""")
def concept_digest(spark, d):
    return rp.concept_digest(table(spark, d, "dictionary_fields"), "category", "cohort")


@query("""SELECT cohort, round(avg(participant_count), 6) AS mean, round(stddev_pop(participant_count), 4) AS deviation, count(participant_count) AS n FROM dictionary_fields GROUP BY cohort""")
def mean_deviation(spark, d):
    return rp.spread(table(spark, d, "dictionary_fields"), "cohort", "participant_count")


# --- retrieval -----------------------------------------------------------------------------------------------------------

_BM = f"""q AS (SELECT row_id AS q, description AS text FROM dictionary_fields WHERE row_id % 100 = 0 AND description IS NOT NULL),
 dw AS (SELECT tinyid AS d, {_TOK.format("concat_ws(' ', designation, question_text, definition)", 2)} AS ts FROM cde_catalog),
 tot AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_len FROM dw),
 po AS (SELECT d, len, term, count(*) AS tf FROM (SELECT d, len(ts) AS len, unnest(ts) AS term FROM dw) GROUP BY ALL),
 fr AS (SELECT term, count(*) AS df FROM po GROUP BY term),
 ask AS (SELECT DISTINCT q, unnest({_TOK.format('text', 2)}) AS term FROM q),
 sc AS (SELECT q, d, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM ask JOIN fr USING (term) JOIN po USING (term), tot GROUP BY q, d)"""


def _catalog_bm25(spark, d):
    q = table(spark, d, "dictionary_fields").where("row_id % 100 = 0 and description is not null").select(F.col("row_id").alias("q"), F.col("description").alias("text"))
    c = table(spark, d, "cde_catalog").select(F.col("tinyid").alias("d"), F.concat_ws(" ", "designation", "question_text", "definition").alias("text"))
    return rx.bm25_scores(q, c)


@query(f"WITH {_BM} SELECT q AS row_id, d AS tinyid, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM sc) WHERE rank <= 5")
def bm25_topk(spark, d):
    return rx.top(_catalog_bm25(spark, d), 5).select(F.col("q").alias("row_id"), F.col("d").alias("tinyid"), "score", "rank")


_DN = """qv AS (SELECT vec_id AS q, label AS ql, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), dv AS (SELECT vec_id AS d, label AS dl, embedding AS dv FROM embeddings),
 ds AS (SELECT q, d, ql, dl, round(list_dot_product(qv::DOUBLE[], dv::DOUBLE[]) / (sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[])) * sqrt(list_dot_product(dv::DOUBLE[], dv::DOUBLE[]))), 6) AS score FROM qv JOIN dv ON q <> d)"""


def _dense(spark, d, k: int):
    e = table(spark, d, "embeddings")
    return rx.dense_top(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("d"), F.col("embedding").alias("dv")), k)


@query(f"WITH {_DN} SELECT q AS vec_id, d AS neighbour_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM ds) WHERE rank <= 10")
def dense_topk(spark, d):
    return _dense(spark, d, 10).select(F.col("q").alias("vec_id"), F.col("d").alias("neighbour_id"), "score", "rank")


_HYB = f"""fv AS (SELECT vec_id AS id, embedding, {_WORDS.format('variable_name')} AS ts FROM field_vectors WHERE embedding IS NOT NULL AND sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) > 0),
 dsc AS (SELECT a.id AS q, b.id AS d, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM fv a JOIN fv b ON a.id <> b.id WHERE a.id % 100 = 0),
 tk AS (SELECT id, list_filter(ts, lambda t: length(t) >= 2) AS ts FROM fv), tot AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_len FROM tk),
 po AS (SELECT d, len, term, count(*) AS tf FROM (SELECT id AS d, len(ts) AS len, unnest(ts) AS term FROM tk) GROUP BY ALL), fr AS (SELECT term, count(*) AS df FROM po GROUP BY term), ask AS (SELECT DISTINCT id AS q, unnest(ts) AS term FROM tk WHERE id % 100 = 0),
 lsc AS (SELECT q, d, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM ask JOIN fr USING (term) JOIN po USING (term), tot WHERE q <> d GROUP BY q, d),
 rk AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM dsc UNION ALL SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) FROM lsc),
 fu AS (SELECT q, d, round(sum(1.0 / (60 + rank)), 6) AS score FROM rk WHERE rank <= 1000 GROUP BY q, d)"""


def _hybrid(spark, d, k: int):
    """Vectors of variables and the words of their names, fused by rank."""
    v = table(spark, d, "field_vectors").where(vx.norm(F.col("embedding")) > 0)
    asked = v.where("vec_id % 100 = 0")
    dense = rx.dense_top(asked.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), v.select(F.col("vec_id").alias("d"), F.col("embedding").alias("dv")), rx.POOL)
    words = F.array_join(tx.words_of_name(F.col("variable_name")), " ").alias("text")
    lexical = rx.bm25_scores(asked.select(F.col("vec_id").alias("q"), words), v.select(F.col("vec_id").alias("d"), words)).where("q <> d")
    return rx.fuse(dense, lexical, k)


@query(f"WITH {_HYB} SELECT q AS vec_id, d AS neighbour_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM fu) WHERE rank <= 10")
def hybrid_rrf_topk(spark, d):
    return _hybrid(spark, d, 10).select(F.col("q").alias("vec_id"), F.col("d").alias("neighbour_id"), "score", "rank")


@query(f"""WITH {_DN}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM ds)
 SELECT q AS vec_id, d AS neighbour_id, round(0.7 * score + 0.3 * CASE WHEN ql = dl THEN 1.0 ELSE 0.0 END, 6) AS blended FROM k WHERE rank <= 5 AND round(0.7 * score + 0.3 * CASE WHEN ql = dl THEN 1.0 ELSE 0.0 END, 6) >= 0.3""")
def value_blend_candidates(spark, d):
    best = _dense(spark, d, 5)
    e = table(spark, d, "embeddings").select("vec_id", "label")
    j = best.join(e.withColumnsRenamed({"vec_id": "q", "label": "ql"}), "q").join(e.withColumnsRenamed({"vec_id": "d", "label": "dl"}), "d")
    out = rx.blend(j, F.when(F.col("ql") == F.col("dl"), 1.0).otherwise(0.0), 0.7, 0.3, 0.3)
    return out.select(F.col("q").alias("vec_id"), F.col("d").alias("neighbour_id"), "blended")


@query(f"""WITH {_DN}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM ds)
 SELECT q AS vec_id, d AS neighbour_id, round(greatest(0.0, least(1.0, 0.6 * CASE WHEN ql = dl THEN 1.0 ELSE 0.2 END + 0.4 * score)), 6) AS confidence,
 CASE WHEN round(greatest(0.0, least(1.0, 0.6 * CASE WHEN ql = dl THEN 1.0 ELSE 0.2 END + 0.4 * score)), 6) >= 0.9 THEN 'auto_approved' WHEN round(greatest(0.0, least(1.0, 0.6 * CASE WHEN ql = dl THEN 1.0 ELSE 0.2 END + 0.4 * score)), 6) <= 0.3 THEN 'auto_rejected' ELSE 'pending_review' END AS review FROM k WHERE rank = 1""")
def pairwise_map_triage(spark, d):
    best = _dense(spark, d, 1)
    e = table(spark, d, "embeddings").select("vec_id", "label")
    j = best.join(e.withColumnsRenamed({"vec_id": "q", "label": "ql"}), "q").join(e.withColumnsRenamed({"vec_id": "d", "label": "dl"}), "d")
    j = j.withColumn("confidence", F.round(rx.mapping_score(F.when(F.col("ql") == F.col("dl"), 1.0).otherwise(0.2), F.col("score")), 6))
    return j.select(F.col("q").alias("vec_id"), F.col("d").alias("neighbour_id"), "confidence", rx.triage(F.col("confidence")).alias("review"))


@query(f"WITH {_DN}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM ds) SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT d FROM k WHERE rank = 1)")
def unmapped_targets(spark, d):
    used = _dense(spark, d, 1).select(F.col("d").alias("vec_id"))
    return table(spark, d, "embeddings").join(used, "vec_id", "left_anti").select("vec_id")


@query(f"""WITH {_DN}, k AS (SELECT q, max(score) AS best FROM ds GROUP BY q) SELECT q AS vec_id, best, CASE WHEN best < 0.3 THEN 'novel' WHEN best >= 0.55 THEN 'adopt' ELSE 'refine' END AS verdict, best < 0.7 AS coverage_gap FROM k""")
def verdict_ladder(spark, d):
    best = _dense(spark, d, 1)
    v, gap = gx.verdict(F.col("score"))
    return best.select(F.col("q").alias("vec_id"), F.col("score").alias("best"), v.alias("verdict"), gap.alias("coverage_gap"))


@query(f"""WITH {_DN}, h AS (SELECT q, ql = dl AS hit, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM ds), m AS (SELECT q, min(CASE WHEN hit THEN rank END) AS r FROM h GROUP BY q)
 SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM m, (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k) GROUP BY k""")
def recall_at_k(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    s = _dense(spark, d, 100).join(e.withColumnsRenamed({"vec_id": "q", "label": "ql"}), "q").join(e.withColumnsRenamed({"vec_id": "d", "label": "dl"}), "d")
    return rp.recall_at(s, F.col("ql") == F.col("dl"), (1, 5, 10, 20, 50, 100))


# --- groups ---------------------------------------------------------------------------------------------------------------

DIM = 64
_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
_CENT = f"{_UNIT}, l AS (SELECT label, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM u) GROUP BY label, i), c AS (SELECT label, max(n) AS n, list(s ORDER BY i) AS c FROM l GROUP BY label), tc AS (SELECT u.label, vec_id, n, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS cos FROM u JOIN c USING (label))"


def _cents(spark, d):
    e = table(spark, d, "embeddings")
    return e, gx.centroids(e, ["label"], "embedding", DIM)


@query(f"WITH {_CENT} SELECT label, vec_id, cos, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS rank FROM tc) WHERE rank <= 6")
def centroid_reps(spark, d):
    e, c = _cents(spark, d)
    return gx.representatives(e, c, ["label"], "vec_id", "embedding")


@query(f"WITH {_CENT} SELECT label, vec_id, cos, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos, vec_id) AS rank FROM tc WHERE n >= 5) WHERE rank <= 1")
def centroid_outliers(spark, d):
    e, c = _cents(spark, d)
    return gx.representatives(e, c.where("n >= 5"), ["label"], "vec_id", "embedding", 1, True)


@query(f"""WITH {_CENT}, m AS (SELECT label, arg_max(vec_id, {{'c': cos, 'i': -vec_id}}) AS mid FROM tc WHERE n > 5 GROUP BY label), mv AS (SELECT m.label, v AS mv FROM m JOIN u ON u.vec_id = m.mid),
 s AS (SELECT tc.label, vec_id, n, round(list_dot_product(v, mv), 6) AS s FROM tc JOIN mv USING (label) JOIN u USING (vec_id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS near, row_number() OVER (PARTITION BY label ORDER BY s, vec_id DESC) AS far FROM s)
 SELECT label, vec_id, CASE WHEN near <= 5 THEN 'core' ELSE 'periphery' END AS part, CAST(CASE WHEN near <= 5 THEN near ELSE far END AS INTEGER) AS place FROM k
 WHERE near <= 5 OR far <= least(n - 5, CASE WHEN n < 10 THEN greatest(1, n - 5) ELSE least(20, greatest(5, (n + 4) // 5)) END)""")
def dual_sample(spark, d):
    return gx.dual_sample(table(spark, d, "embeddings"), "label", "vec_id", "embedding", DIM)


@query(f"""WITH {_UNIT}, s AS (SELECT label AS g, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM u) GROUP BY label, i), c AS (SELECT g, max(n) AS gn, list(s ORDER BY i) AS gs FROM s GROUP BY g),
 x AS (SELECT u.label, vec_id, g = label AS own, CASE WHEN g = label THEN CASE WHEN gn > 1 THEN 1 - (list_dot_product(v, gs) - 1) / (gn - 1) END ELSE 1 - list_dot_product(v, gs) / gn END AS dist FROM u, c),
 ab AS (SELECT label, vec_id, max(CASE WHEN own THEN dist END) AS a, min(CASE WHEN NOT own THEN dist END) AS b FROM x GROUP BY ALL)
 SELECT label, count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0.0)), 6) AS silhouette FROM ab GROUP BY label""")
def silhouette_by_label(spark, d):
    return gx.silhouette(table(spark, d, "embeddings"), "label", "vec_id", "embedding", DIM)


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first_part, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings")
def l2_normalize(spark, d):
    n = vx.norm(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double") / n, 6).alias("first_part"), F.round(n, 6).alias("length"))


_FV = "fv AS (SELECT dictionary_name || '/' || category AS rec, category, embedding FROM field_vectors WHERE category IS NOT NULL AND embedding IS NOT NULL AND sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) > 0)"
_MERGE = f"""{_FV}, fu AS (SELECT rec, category, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM fv),
 fs AS (SELECT rec, category, i, sum(v[i]) AS s FROM (SELECT rec, category, v, unnest(range(1, 65)) AS i FROM fu) GROUP BY ALL), fc AS (SELECT rec, category, list(s ORDER BY i) AS c FROM fs GROUP BY ALL),
 mp AS (SELECT a.rec AS a, b.rec AS b, round(list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c))), 6) AS cos FROM fc a JOIN fc b ON a.category = b.category AND a.rec < b.rec)"""


def _merge_pairs(spark, d, tau: float):
    v = table(spark, d, "field_vectors").where("category is not null and embedding is not null").withColumn("rec", F.concat_ws("/", "dictionary_name", "category"))
    c = gx.centroids(v, ["rec", "category"], "embedding", DIM)  # one row for each dictionary and category
    a, b = c.select("category", F.col("rec").alias("a"), F.col("centroid").alias("ca")), c.select("category", F.col("rec").alias("b"), F.col("centroid").alias("cb"))
    return a.join(b, "category").where("a < b").select("a", "b", F.round(vx.dot(F.col("ca"), F.col("cb")), 6).alias("cos")).where(F.col("cos") >= tau)


@query(f"WITH {_MERGE} SELECT a, b, cos FROM mp WHERE cos >= 0.6")
def merge_pairs(spark, d):
    return _merge_pairs(spark, d, 0.6)


@query(f"WITH RECURSIVE {_MERGE}, e AS MATERIALIZED (SELECT a AS u, b AS v FROM mp WHERE cos >= 0.6 UNION SELECT b, a FROM mp WHERE cos >= 0.6), t AS (SELECT DISTINCT u AS x, u AS y FROM e UNION SELECT t.x, e.v FROM t JOIN e ON t.y = e.u) SELECT x AS record, min(y) AS component FROM t GROUP BY x")
def merge_components(spark, d):
    return connected_components(_merge_pairs(spark, d, 0.6)).select(F.col("node").alias("record"), "component")


@query("""WITH e AS (SELECT l_partkey % 200 AS rec, CASE WHEN l_discount <= 0.02 THEN 'none' WHEN l_discount <= 0.06 THEN 'recode' WHEN l_discount <= 0.09 THEN 'identity' ELSE 'unit' END AS kind FROM lineitem)
 SELECT rec, count(*) AS n_coded, round(avg(CASE WHEN kind = 'none' THEN 1.0 ELSE 0.0 END), 6) AS none_share, count(*) >= 3 AND round(avg(CASE WHEN kind = 'none' THEN 1.0 ELSE 0.0 END), 6) >= 0.3 AS flagged FROM e WHERE kind IN ('recode', 'identity', 'none') GROUP BY rec""")
def coherence_gate(spark, d):
    disc = F.col("l_discount")
    e = table(spark, d, "lineitem").select((F.col("l_partkey") % 200).alias("rec"), F.when(disc <= 0.02, "none").when(disc <= 0.06, "recode").when(disc <= 0.09, "identity").otherwise("unit").alias("kind"))
    return gx.coherence_gate(e, "rec", "kind", 0.3)


@query("""WITH r AS (SELECT category AS target, variable_name, min(row_id) AS row_id, count(*) AS n, max(coalesce(participant_count, 0)) AS score FROM dictionary_fields WHERE category IS NOT NULL AND variable_name IS NOT NULL GROUP BY ALL),
 w AS (SELECT *, count(*) OVER (PARTITION BY target, substr(lower(variable_name), 1, 6)) AS c, row_number() OVER (PARTITION BY target, substr(lower(variable_name), 1, 6) ORDER BY score DESC, variable_name) AS k, sum(n) OVER (PARTITION BY target, substr(lower(variable_name), 1, 6)) AS s FROM r)
 SELECT target, variable_name, row_id, CASE WHEN c >= 4 THEN CAST(s AS BIGINT) ELSE n END AS n, score, c >= 4 AS collapsed FROM w WHERE c < 4 OR k = 1""")
def family_collapse(spark, d):
    r = table(spark, d, "dictionary_fields").where("category is not null and variable_name is not null").groupBy(F.col("category").alias("target"), "variable_name").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"), F.max(F.coalesce("participant_count", F.lit(0))).alias("score"))
    return gx.collapse_families(r, "target", "variable_name", "score", "n").select("target", "variable_name", "row_id", "n", "score", "collapsed")


@query(f"""WITH {_DN}, k AS (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank, dl FROM ds), b AS (SELECT q, dl, min(rank) AS best FROM k WHERE rank <= 1000 GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY best) AS gr FROM b),
 m AS (SELECT k.*, g.gr, row_number() OVER (PARTITION BY k.q, k.dl ORDER BY rank) AS inside FROM k JOIN g USING (q, dl) WHERE gr <= 3 AND rank <= 1000)
 SELECT q AS vec_id, d AS neighbour_id, CAST(gr AS INTEGER) AS group_rank, CAST(inside AS INTEGER) AS inside FROM m WHERE inside <= 4""")
def group_diverse_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("d"), F.col("label").alias("dl"))
    k = _dense(spark, d, rx.POOL).join(e, "d")
    return rp.diverse(k, "dl").select(F.col("q").alias("vec_id"), F.col("d").alias("neighbour_id"), "group_rank", "inside")


@query(f"""WITH t AS (SELECT DISTINCT units AS g, description AS l FROM dictionary_fields WHERE units IS NOT NULL AND description IS NOT NULL), k AS (SELECT g, l, list_distinct({_TOK.format('l', 1)}) AS ts FROM t),
 n AS (SELECT g, count(*) AS n FROM k GROUP BY g HAVING count(*) >= 8), d AS (SELECT g, w, count(*) AS df FROM (SELECT g, unnest(ts) AS w FROM k) GROUP BY ALL),
 w AS (SELECT g, n, list(w ORDER BY w) AS tw FROM d JOIN n USING (g) WHERE df >= 0.3 * n GROUP BY ALL HAVING count(*) >= 2),
 f AS (SELECT k.g, n, tw, list_sort(list_filter(ts, lambda x: NOT list_contains(tw, x))) AS slot FROM k JOIN w USING (g) WHERE len(list_intersect(ts, tw)) = len(tw)),
 o AS (SELECT g, n, tw, count(*) AS fits, count(DISTINCT list_aggregate(slot, 'string_agg', ' ')) AS n_slots FROM f WHERE len(slot) BETWEEN 1 AND 12 GROUP BY ALL)
 SELECT g AS units, list_aggregate(tw, 'string_agg', ' ') AS template, n AS n_members, n_slots FROM o WHERE n_slots >= 8 AND fits >= 0.1 * n""")
def enumerated_families(spark, d):
    return fx.enumerated_families(table(spark, d, "dictionary_fields"), "units", "description", 8, 0.3, 2, 12, 0.1)


@query("""WITH t AS (SELECT cohort, lower(regexp_extract(variable_name, '^(.*?)[._]?([0-9]+)$', 1)) AS stem, TRY_CAST(regexp_extract(variable_name, '^(.*?)[._]?([0-9]+)$', 2) AS BIGINT) AS num, variable_name FROM dictionary_fields WHERE regexp_matches(variable_name, '[A-Za-z].*[0-9]$')),
 o AS (SELECT cohort, stem, num, min(variable_name) AS c FROM t GROUP BY ALL) SELECT cohort, stem, count(*) AS n_columns, string_agg(c, ',' ORDER BY num NULLS FIRST, c) AS columns FROM o GROUP BY ALL HAVING count(*) >= 2""")
def wide_to_long_specs(spark, d):
    return fx.wide_to_long_specs(table(spark, d, "dictionary_fields"), "cohort", "variable_name", "row_id", 2)


@query("SELECT row_id, encoding_id IS NOT NULL AND count(*) OVER (PARTITION BY encoding_id) >= 8 AS magnet FROM dictionary_fields")
def magnet_flags(spark, d):
    return fx.magnets(table(spark, d, "dictionary_fields").select("row_id", "encoding_id"), "encoding_id").select("row_id", "magnet")


@query(r"""WITH o AS (SELECT DISTINCT data_type AS k, lower(trim(regexp_replace(units, '\s+', ' ', 'g'))) AS l FROM dictionary_fields WHERE units IS NOT NULL AND data_type IS NOT NULL), f AS (SELECT DISTINCT data_type AS k, lower(trim(regexp_replace(units, '\s+', ' ', 'g'))) AS l FROM field_references WHERE units IS NOT NULL AND data_type IS NOT NULL),
 c AS (SELECT o.k, count(*) AS n_observed, round(count(f.l) / count(*), 6) AS coverage FROM o LEFT JOIN f ON o.k = f.k AND o.l = f.l GROUP BY o.k), e AS (SELECT data_type AS k FROM dictionary_fields WHERE data_type IS NOT NULL UNION SELECT data_type FROM field_references WHERE data_type IS NOT NULL)
 SELECT e.k AS data_type, coalesce(n_observed, 0) AS n_observed, coalesce(coverage, 1.0) AS coverage FROM e LEFT JOIN c ON e.k = c.k""")
def label_coverage(spark, d):
    pick = lambda t: table(spark, d, t).where("data_type is not null").select("data_type", "units")
    return fx.label_coverage(pick("dictionary_fields"), pick("field_references"), "data_type", "units")


@query(r"""SELECT row_id, CASE WHEN len(regexp_extract_all(description, '[0-9]+(?:\.[0-9]+)?')) = 1 THEN TRY_CAST(regexp_extract_all(description, '[0-9]+(?:\.[0-9]+)?')[1] AS DOUBLE) END AS cut,
 coalesce(least(1.0, greatest(0.0, TRY_CAST(encoding_id AS DOUBLE) / 2000)), 0.0) AS confidence FROM dictionary_fields""")
def cut_points(spark, d):
    return table(spark, d, "dictionary_fields").select("row_id", fx.cut_point(F.col("description")).alias("cut"), fx.clamp(F.col("encoding_id").try_cast("double") / 2000).alias("confidence"))


@query("""SELECT event_id, CAST(1 AS INTEGER) AS pos, '{"k": ' || json_extract_string(props, '$.k') || '}' AS object FROM events""")
def salvaged_answers(spark, d):
    t = table(spark, d, "events").select("event_id", F.concat(F.lit("answer: ["), F.col("props"), F.lit(', {"cut": ')).alias("answer"))
    return fx.salvaged(t, "event_id", "answer")


@query()
def chunk_oversized(spark, d):
    """Average-linkage bisection has no SQL form; it is tested against brute force on small groups."""
    v = table(spark, d, "embeddings")
    return gx.chunk(v, "label", "vec_id", "embedding")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
