import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import answers as an
from fieldloom.functions import text as tx
from fieldloom.functions import values as vx
from fieldloom.operators import composites as cx
from fieldloom.operators import dictionary as dx
from fieldloom.operators import elements as ex
from fieldloom.operators import groups as gx
from fieldloom.operators import pipeline as px
from fieldloom.operators import reports as rp
from fieldloom.operators import retrieval as rt
from fieldloom.operators import specs as sx
from fieldloom.plans import stages as st
from fieldloom.sources import vector_cache


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("label", ["Missing data", "Refused to answer", "Declined", "dk", "not sure", "Prefer not to disclose", "", None, "N/A", "do not know", "Data missing (-9)"])
def test_sentinels(spark, label):
    assert one(spark, tx.is_sentinel(F.lit(label).cast("string")))[0]


@pytest.mark.parametrize("label", ["banana", "dka", "Yes", "unknown origin", "No"])
def test_no_sentinels(spark, label):
    assert not one(spark, tx.is_sentinel(F.lit(label)))[0]


def test_cleaning(spark):
    cases = {
        'ACE touchscreen question "Do you smoke?"<p>Help</p>': "Do you smoke?",
        "Questions about diet": "Questions about diet",
        '"Do not know"': '"Do not know"',
        '"Height?"<br>see help': "Height?",
        "a <OR> b <50% &amp; c": "a <OR> b <50% & c",
        "  a\n b ": "a b",
        "<p></p>": "",
    }
    for text, want in cases.items():
        assert one(spark, tx.clean(F.lit(text)))[0] == want
    assert one(spark, tx.clean(F.lit("Which? Select all that apply"), True))[0] == "Which?"
    assert one(spark, tx.clean_or_keep(F.lit("<p></p>")))[0] == "<p></p>"
    assert one(spark, tx.strip_sentinels(F.lit("-9=MISSING|0=No|1=Yes|9=Do not know")), tx.strip_sentinels(F.lit("-9=MISSING"))) == ("0=No|1=Yes", None)


def test_units(spark):
    rows = [("mg", "kg", 1e-6, 0.0), ("oz", "g", 28.349523125, 0.0), ("°F", "deg C", 5 / 9, -160 / 9), ("K", "°C", 1.0, -273.15), ("Months", "yr.", 1 / 12, 0.0), ("mL", "L", 0.001, 0.0), ("%", "fraction", 0.01, 0.0), ("mg/dL", "g/L", None, None), ("kg", "cm", None, None), (None, "kg", None, None)]
    t = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, a string, b string")
    got = {r.i: r for r in sx.unit_specs(t, "a", "b").collect()}
    for i, (_, _, f, o) in enumerate(rows):
        assert (got[i].factor is None) == (f is None) and got[i].needs_units == (f is None)
        if f is not None:
            assert got[i].factor == pytest.approx(f, abs=1e-9) and got[i].base_offset == pytest.approx(o, abs=1e-9) and got[i].confidence == 0.9
    (r,) = sx.unit_specs(spark.createDataFrame([("mg/dL", "MG/DL ")], "a string, b string"), "a", "b").collect()
    assert (r.kind, r.needs_units, r.confidence) == ("identity", False, 0.9)


def test_formulas(spark):
    names = {"a": F.lit(7.0), "b": F.lit(-2.0), "z": F.lit(0.0)}
    for text in ("a // b", "a % b", "round(a / 3, 2)", "floor(b / 3) + ceil(a / 2)", "min(a, b, z)", "log10(a) + log2(a)", "-a ** 2"):
        import math

        want = eval(text, {"__builtins__": {}}, {"a": 7.0, "b": -2.0, "z": 0.0, "round": round, "floor": math.floor, "ceil": math.ceil, "min": min, "log10": math.log10, "log2": math.log2})
        assert one(spark, vx.compile_formula(text, names))[0] == pytest.approx(want)
    for text in ("a / z", "a % z", "a // z", "z ** -1"):
        assert one(spark, vx.compile_formula(text, names))[0] is None
    assert vx.is_safe_formula("a + b", ["a", "b"]) and not vx.is_safe_formula("open('x')", []) and not vx.is_safe_formula("a.b", ["a"]) and not vx.is_safe_formula("", [])
    assert vx.is_identity_formula("source") and not vx.is_identity_formula("source + 0")


def test_ordinal_fill(spark):
    cases = [(["1", "2", "3"], ["0", "1", "2"], {"1": "0", "3": "2"}), (["1", "2"], ["0", "1"], {"1": "0"}), (["1", "2", "3"], ["0", "1", "2"], {"1": "2", "3": "0"}), (["1", "1", "3"], ["0", "1", "2"], {"1": "0", "3": "2"}), (["a", "b", "c"], ["0", "1", "2"], {"a": "0", "b": "1"}), (["1", "2", "3"], ["1", "2", "3"], {"1": "1", "2": "2", "3": "3"})]
    want = [{"1": "0", "2": "1", "3": "2"}, None, None, None, None, None]
    assert [vx.ordinal_fill(*c) for c in cases] == want
    t = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s array<string>, t array<string>, m map<string,string>")
    assert [r.f for r in t.select("i", sx.filled(F.col("s"), F.col("t"), F.col("m")).alias("f")).orderBy("i").collect()] == want


def test_answers():
    assert json.loads(an.find_object('Sure:\n```json\n{"a": {"b": 1}}\n``` done')) == {"a": {"b": 1}}
    assert json.loads(an.find_object('x {"a": 1} y {"b": 2, "c": [3]}')) == {"b": 2, "c": [3]}
    assert json.loads(an.find_object('{"content": "{\\"verdict\\": \\"adopt\\"}"}')) == {"verdict": "adopt"}
    assert an.find_object("no { object") is None and an.find_object(None) is None
    assert [json.loads(x) for x in an.find_items('{"items": [{"a": 1}, {"b": "}"}, {"c": ', "items")] == [{"a": 1}, {"b": "}"}]
    assert [json.loads(x) for x in an.find_items('[{"a": oops}, {"b": 2}]')] == [{"b": 2}]
    assert an.find_items("none") == []


def test_preparation_golden(spark):
    """Seventeen fields with every kind of dirt; counts as stated for them."""
    wrapped = 'ACE touchscreen question "How often do you feel tired?"<p>Help text</p>'
    rows = [
        ("bmi", wrapped, "", None), ("sleep", "It’s sleep", "", None), ("walk", "Minutes  of  walking", "", None), ("mood", '"Do not know"', "1=Yes|2=Do not know", None), ("heart_rate", "Resting heart rate", "", None),
        *((f"study_alpha_placeholder_item{chr(97 + i)}", "Field description available on request", "", None) for i in range(12)),
    ]
    t = spark.createDataFrame([(i, i, "c", n, d, e, q) for i, (n, d, e, q) in enumerate(rows)], "row_id long, ord long, cohort string, variable_name string, description string, value_encoding string, question_text string")
    # names of one part bound the prefix, so it is looked for among the twelve
    p = dx.prepare(t.where("row_id >= 5"), prefix_ratio=0.5)
    r = dx.preparation_report(p).first()
    assert (r.n_fields, r.n_placeholders, r.n_prefix, r.n_dedup, r.names_changed, r.descriptions_changed) == (12, 12, 12, 12, 12, 12)
    assert {x.variable_name for x in p.collect()} == {f"item{chr(97 + i)}" for i in range(12)}
    r = dx.preparation_report(dx.prepare(t.where("row_id < 5"))).first()
    assert (r.n_fields, r.n_unicode, r.n_administrative, r.n_echo, r.n_placeholders, r.n_whitespace, r.n_dedup) == (5, 1, 2, 1, 0, 0, 3)
    off = dx.prepare(t, ()).collect()
    assert all(x.variable_name == x.raw_variable_name and x.description == x.raw_description and x.question_text == x.raw_question_text for x in off)
    assert dx.prepare(t.limit(0)).count() == 0


def test_names_stay_apart(spark):
    t = spark.createDataFrame([(1, 1, "c", "x"), (2, 2, "c", "x"), (3, 3, "c", "x__2"), (4, 4, "d", "x")], "row_id long, ord long, cohort string, variable_name string")
    assert {r.row_id: r.unique_name for r in dx.distinct_names(t).collect()} == {1: "x", 2: "x____2", 3: "x__2", 4: "x"}


def brute_linkage(x, parts):
    d, sets = 1 - x @ x.T, [[i] for i in range(len(x))]
    while len(sets) > parts:
        _, i, j = min((float(np.mean(d[np.ix_(a, b)])), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j)
        sets[i] += sets.pop(j)
    return {frozenset(s) for s in sets}


@pytest.mark.parametrize("seed", range(4))
def test_linkage_against_plain_agglomeration(seed):
    x = np.random.default_rng(seed).normal(size=(30, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    merges, heights = gx.linkage(x)
    assert (np.diff(heights) >= -1e-12).all()
    for parts in (2, 5, 12):
        label = gx.cut_tree(merges, 30, parts)
        assert {frozenset(np.nonzero(label == k)[0]) for k in set(label)} == brute_linkage(x, parts)


def test_chunks_bisect_by_linkage(spark):
    """Until no part is above the cap, the last merge of average linkage is undone."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def split(m):
        if len(m) <= 10:
            return {frozenset(m)}
        a, b = (sorted(s) for s in brute_linkage(unit[m], 2))
        return split([m[i] for i in a]) | split([m[i] for i in b])

    df = spark.createDataFrame([(i, "g", x[i].tolist()) for i in range(60)], "id long, g string, v array<double>")
    got = {}
    for r in gx.chunk(df, "g", "id", "v", 10).collect():
        got.setdefault(r.chunk, set()).add(r.id)
    assert {frozenset(s) for s in got.values()} == split(list(range(60)))


def test_cut_of_best_silhouette():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(15, 6)) * 0.05 + c for c in np.eye(6)[:3]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = gx.suggest_cuts(x, gx.linkage(x)[0])[0]
    assert best[0] == 3 and best[1] > 0.9


def test_main_world(spark):
    """Two cohorts and a catalog of four; two variables worded alike are two concepts."""
    e = np.eye(4)
    members = spark.createDataFrame([("k", "a", "bmi", "body mass index", e[0].tolist()), ("k", "b", "BMI_calc", "body mass index", (e[0] + 0.1 * e[1]).tolist()), ("k", "a", "age", "age", e[1].tolist()), ("k", "b", "odd", "odd one", e[3].tolist())], "cluster_id string, cohort string, variable_name string, text string, vec array<double>")
    catalog = spark.createDataFrame([("Body mass index", e[0].tolist()), ("Age", e[1].tolist()), ("Weight", e[2].tolist()), ("zero", [0.0] * 4)], "cde_id string, vec array<double>")
    split = spark.createDataFrame([("split:k", '{"groups": [{"member_ids": ["m2", "[m4]", "m4"], "concept": "BMI"}, {"member_ids": ["1", "m99"], "concept": "Age"}]}')], "id string, answer string")
    # in order of cohort and name: m1 age, m2 bmi, m3 BMI_calc, m4 odd
    groups = px.split_groups(members, split)
    at = {(r.cohort, r.variable_name): (r.group_id, r.concept) for r in groups.collect()}
    assert at == {("a", "age"): ("k#g1", "Age"), ("a", "bmi"): ("k#g0", "BMI"), ("b", "BMI_calc"): ("k#g2", ""), ("b", "odd"): ("k#g0", "BMI")}
    candidates = px.retrieve(groups, catalog, 4)
    assigned = spark.createDataFrame([("assign:k#g0", '{"verdict": "adopt", "cde_id": "1"}'), ("assign:k#g1", '{"verdict": "adopt", "cde_id": 1, "rationale": "same"}'), ("assign:k#g2", '{"verdict": "refine", "cde_id": 3}')], "id string, answer string")
    got = {r.group_id: (r.verdict, r.route, r.cde_id, r.floored, r.adopt_demoted) for r in px.assign(groups, candidates, assigned, 0.3, 0.8).collect()}
    assert got == {"k#g0": ("refine", "assigned", "Body mass index", False, True), "k#g1": ("adopt", "assigned", "Age", False, False), "k#g2": ("novel", "gencde_residual", None, True, False)}
    none = px.assign(groups, candidates, assigned.limit(0)).collect()
    assert len(none) == 3 and all(r.verdict == "" and r.cde_id is None for r in none)
    prompts = px.assign_prompts(groups, candidates, catalog.withColumn("text", F.col("cde_id"))).where("group_id = 'k#g1'").first()
    assert prompts.user_prompt.startswith("Concept: Age\nMembers:\nage\nCandidates:\n[1] Age")


def test_medoid_sample(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(14, 3)) + 2
    df = spark.createDataFrame([(i, "g", x[i].tolist()) for i in range(14)] + [(20 + i, "small", x[i].tolist()) for i in range(5)], "id long, g string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    order = np.argsort(-s[s.sum(axis=1).argmax()], kind="stable").tolist()
    got = {(r.id, r.part) for r in gx.dual_sample(df, "g", "id", "v", 3).collect()}
    assert got == {(i, "core") for i in order[:5]} | {(i, "periphery") for i in order[-5:]}


def test_merge_leads_with_the_assigned(spark):
    records = spark.createDataFrame([("a", "novel", None, 9), ("b", "refine", "X", 2), ("c", "adopt", "Y", 5), ("d", "", None, 1)], "group_id string, verdict string, cde_id string, n_members long")
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    got = {r.group_id: (r.n_members, r.n_merged, r.merged_from) for r in px.merge_records(records, links).collect()}
    assert got == {"c": (16, 3, "a,b,c"), "d": (1, 1, "d")}


def test_close_pairs_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(50, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "k long, v array<double>")
    monkeypatch.setattr(gx, "PAIR_BLOCK", 12)
    s = x @ x.T
    assert {(r.a, r.b) for r in gx.close_pairs(df, "k", "v", 0.8).collect()} == {(i, j) for i in range(50) for j in range(i + 1, 50) if s[i, j] >= 0.8}


def test_refinement(spark):
    base = ("n", "Definition", None, "text", None, "1=Yes|2=No")
    cols = "id long, preferred_name string, definition string, question_text string, data_type string, units string, permissible_values string"
    parent = spark.createDataFrame([(i, *base) for i in range(4)], cols)
    refined = spark.createDataFrame([(0, "N ", "definition", "Ask?", "text", None, "2=no|1=YES"), (1, "n", "Other", "", "number", "kg", "1=Yes|2=No|3=Maybe"), (2, *base[:5], "1=Red|2=Blue"), (3, None, None, None, None, None, None)], cols)
    got = {r.id: (r.changed, r.completed, r.delta_size, r.over_refined) for r in sx.deltas(refined, parent, "id").collect()}
    assert got == {0: ([], ["question_text"], 0.0, False), 1: (["definition", "data_type", "permissible_values"], ["units"], 0.5, False), 2: (["permissible_values"], [], 0.167, True), 3: ([], [], 0.0, False)}
    gaps = sx.closed_gaps(spark.createDataFrame([(1, "E", ["3", "4"])], "spec_id int, element_id string, unmapped array<string>"), spark.createDataFrame([(1, "3", " May  be"), (1, "4", "Else")], "spec_id int, code string, label string"), spark.createDataFrame([("E", "9", "may be")], "element_id string, code string, label string"))
    assert [tuple(r) for r in gaps.collect()] == [(1, "3", "9")]


def test_repeating_measures(spark):
    rows = [("m", f"Medication {i}") for i in range(1, 13)] + [("d", x) for x in ("Height", "Weight", "Age", "Sex", "Pulse")] + [("t", f"Item {i}") for i in (1, 2, 3)] + [("s", f"Item {i}") for i in (1, 200, 4000, 90000)]
    got = sx.repeating_measures(spark.createDataFrame(rows, "group_id string, label string"), "label").collect()
    assert [(r.group_id, r.signature, r.n_occurrences, r.lo, r.hi, r.density) for r in got] == [("m", "medication #", 12, 1, 12, 1.0)]


def test_recode_forms(spark):
    t = spark.createDataFrame([(1, "1=Yes|2=No", "a=Yes|b=No", '{"code_map": {"1": "a", "2": "zz"}, "confidence": 0.9}'), (2, "1=Yes|2=No", "a=Yes|b=No", None), (3, "1=Yes|2=No", "1=Yes|2=No", '{"recodes": [{"code_map": {"1": "1", "2": "2"}, "confidence": 2}]}')], "id int, s string, t string, p string")
    got = {r.id: (r.kind, r.code_map, r.unmapped, r.coverage, r.needs_review) for r in sx.recode_specs(t, "s", "t", "p").collect()}
    assert got == {1: ("categorical", {"1": "a"}, ["2"], 0.5, True), 2: ("none", {}, ["1", "2"], 0.0, True), 3: ("identity", {"1": "1", "2": "2"}, [], 1.0, False)}


def test_composites(spark):
    components = spark.createDataFrame([("x", True), ("y", True), ("z", False)], "component string, required boolean")
    covered = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "b")], "component string, cohort string")
    cohorts = spark.createDataFrame([("a",), ("b",), ("c",)], "cohort string")
    got = {r.cohort: (r.n_required, r.n_present, r.missing, r.computable, r.verdict) for r in cx.feasibility(components, covered, cohorts).collect()}
    assert got == {"a": (2, 2, "", True, "full"), "b": (2, 1, "y", False, "full"), "c": (2, 0, "x,y", False, "full")}
    assert cx.combination("deficit_proportion", ["a", "b"]) == "score = (a + b) / 2"
    assert cx.combination("weighted_sum", ["a", "b"], [2, None]).startswith("# REVIEW") and cx.combination("sum", []).startswith("# NOT COMPUTABLE")
    assert cx.combination("weighted_sum", ["a", "b"], [2, 3]) == "score = 2 * a + 3 * b"


def test_documents(spark):
    cols = "element_id string, preferred_name string, definition string, question_text string, data_type string, units string, permissible_values string, cohorts array<string>, n_variables long, parent_id string, axis string"
    t = spark.createDataFrame([("G:1", "Pain", " ", "Pain?", None, None, "1=Yes|2=No", ["a", "b"], 3, None, None)], cols)
    doc = json.loads(ex.documents(t).first().document)
    assert doc["tinyId"] == "" and [x["designation"] for x in doc["designations"]] == ["Pain", "Pain?"] and doc["definitions"] == [] and doc["derivationRules"] == []
    assert doc["valueDomain"]["datatype"] == "Value List" and doc["valueDomain"]["permissibleValues"][1] == {"permissibleValue": "2", "valueMeaningName": "No"}
    assert "a, b" in doc["sources"][0]["sourceName"]


def test_vector_cache(spark, tmp_path):
    path, calls = str(tmp_path / "vectors"), spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    t = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abc"), (4, None)], "id int, t string")
    assert {r.id: r.vec for r in vector_cache.embedded(t, "t", encoder, path).collect()} == {1: [2.0], 2: [2.0], 3: [3.0], 4: None}
    assert {r.id: r.vec for r in vector_cache.embedded(t.union(spark.createDataFrame([(5, "abcd")], "id int, t string")), "t", encoder, path).collect()}[5] == [4.0]
    assert calls.value == 3
    assert {r.id: r.vec for r in vector_cache.lookup(t, "t", path).collect()}[3] == [3.0]


def test_reports(spark):
    t = spark.createDataFrame([("g", "home_phone"), ("g", "workPhone"), ("h", "sex"), ("h", "biological_sex"), (None, "home")], "g string, n string")
    assert [tuple(r) for r in rp.diverging_qualifiers(t, "g", "n").collect()] == [("g", "home,work")]
    labels = [("m", f"how often do you eat {x}") for x in ("apples", "pears", "plums", "figs")] + [("m", f"how much do you like {x}") for x in ("milk", "tea", "beer", "rum")] + [("o", x) for x in ("age", "height", "sex", "weight", "pulse", "income")]
    assert [tuple(r) for r in rp.matrix_suspects(spark.createDataFrame(labels, "g string, l string"), "g", "l").collect()] == [("m", 8, 2)]
    f = spark.createDataFrame([("a", "teeth", "Which of these?", "Checkbox (multiple)", "1=Pain|2=Bleeding|-7=None|3=Loose"), ("a", "mood", "mood", "radio", "1=Good|2=Bad|3=So so"), ("a", None, "q", None, None)], "c string, n string, q string, t string, e string")
    got = {r.concept_id: (r.concept, r.answer_text) for r in rp.variable_index(f, "c", "n", "q", "t", "e").collect()}
    assert got == {"a:teeth": ("teeth - Which of these?", "Pain; Bleeding; Loose"), "a:mood": ("mood", "Good; Bad; So so"), "a:teeth#opt=Pain": ("teeth - Pain", "Pain"), "a:teeth#opt=Bleeding": ("teeth - Bleeding", "Bleeding"), "a:teeth#opt=Loose": ("teeth - Loose", "Loose")}
    assert one(spark, rp.prices(F.lit("small-2"), {"s": 1.0, "small": 2.0}, 9.0))[0] == 2.0 and one(spark, rp.prices(F.lit("x"), {"s": 1.0}, 9.0))[0] == 9.0


@pytest.mark.parametrize("k", [1, 4, 50])
def test_nearest_in_blocks(spark, monkeypatch, k):
    monkeypatch.setattr(rt, "QUERY_BLOCK", 9)
    monkeypatch.setattr(rt, "TASK_PAIRS", 64)
    monkeypatch.setattr(rt, "ROWS_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(20, 4)), np.repeat(rng.normal(size=(10, 4)), 3, axis=0)  # every element thrice: ties go by id
    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    ids = [f"e{i}" for i in rng.permutation(30)]
    rows = spark.createDataFrame([(f"g{i}", v.tolist()) for i, v in enumerate(x)], "q string, qv array<double>")
    elements = spark.createDataFrame([(d, v.tolist()) for d, v in zip(ids, y)], "d string, dv array<double>")
    got = sorted((r.q, r["rank"], r.d, r.cos) for r in rt.nearest(rows, elements, k).collect())
    want = []
    for i, s in enumerate(np.round(x @ y.T, 6)):
        want += [(f"g{i}", n + 1, d, -c) for n, (c, d) in enumerate(sorted(zip(-s, ids))[:k])]
    assert got == sorted(want)
    assert rt.nearest(rows, elements.limit(0), k).count() == 0


def test_retrieval_forms_no_pairs(spark):
    groups = spark.createDataFrame([(f"g{i % 3}", [1.0, float(i)]) for i in range(9)], "group_id string, vec array<double>")
    catalog = spark.createDataFrame([("c1", [1.0, 2.0]), ("c2", [0.0, 0.0]), ("c3", [3.0, 1.0])], "cde_id string, vec array<double>")
    found = px.retrieve(groups, catalog, 2, 1)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.group_id, r.cde_id) for r in found.collect()) == [("g0", "c1"), ("g1", "c1"), ("g2", "c1")]


def test_many_centroids_across_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 5 == 0 else f"g{i % 5 % 3}", rng.normal(size=3).tolist()) for i in range(60)] + [("z", [0.0, 0.0, 0.0]), ("n", None), ("e", [1.0, 0.0, 0.0]), ("e", [-2.0, 0.0, 0.0])]
    t = spark.createDataFrame(rows, "g string, v array<double>").repartition(3)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(size)
    spark.conf.set(size, "2")
    try:
        got = {r.g: r for r in gx.many_centroids(t, "g", "v", 3).collect()}
    finally:
        spark.conf.set(size, kept)
    want = {r.g: r for r in gx.centroids(t, ["g"], "v", 3).collect()}
    assert set(got) == set(want) == {None, "g0", "g1", "g2"}
    for g, r in want.items():
        assert got[g].n == r.n and got[g].centroid == pytest.approx(r.centroid, abs=1e-12)


def test_chain_is_written_once(spark):
    groups, candidates, _ = st._chain(spark, "/root/testdata/sf0.001")
    for t in (groups, candidates):
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "Exchange" not in plan and "MapInArrow" not in plan


def test_merge_links_join_what_pairs_join(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(6, 4)), 8, axis=0) + 0.1 * rng.normal(size=(48, 4))  # crowds
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"g{'x' * int(n)}{i}" for i, n in enumerate(rng.integers(0, 4, 48))]
    cents = spark.createDataFrame([(g, v.tolist()) for g, v in zip(ids, x)], "group_id string, centroid array<double>")
    groups = spark.createDataFrame([(g, f"v{i}_{'a' if i in (0, 47) else i}") for i, g in enumerate(ids)], "group_id string, name string")
    monkeypatch.setattr(gx, "LINK_BLOCK", 13)
    monkeypatch.setattr(gx, "LINK_TASK", 7)
    monkeypatch.setattr(gx, "LINK_ROWS", 3)
    links = [(r.a, r.b) for r in px.merge_links(groups, cents, "name", st._merge_said, st._MERGE_TEXTS, 0.9).collect()]
    pairs = [(ids[i], ids[j]) for i in range(48) for j in range(i) if round(float(x[i] @ x[j]), 6) >= 0.9]
    pairs += [(r.a, r.b) for r in px._alike(groups, "name").collect()]
    pairs = [(a, b) for a, b in pairs if (len(a) + len(b)) % 3]

    def parts(edges):
        at = {g: {g} for g in ids}
        for a, b in edges:
            one = at[a] | at[b]
            at.update(dict.fromkeys(one, one))
        return {frozenset(v) for v in at.values()}

    assert parts(links) == parts(pairs) and len(parts(pairs)) < 40
    assert {frozenset(e) for e in links} <= {frozenset(e) for e in pairs}


def test_cosines_round_as_in_sql(spark):
    groups = spark.createDataFrame([("g", "k", "", "a")], "group_id string, cluster_id string, concept string, cohort string")
    candidates = spark.createDataFrame([("g", 1, "c", 0.76455)], "group_id string, rank int, cde_id string, cos double")
    said = spark.createDataFrame([("assign:g", '{"verdict": "adopt", "cde_id": 1}')], "id string, answer string")
    r = px.assign(groups, candidates, said).first()
    assert (r.chosen_cos, r.top1_cos) == (0.7645, 0.7645)


@pytest.mark.parametrize("name", ["refinement_axes", "group_candidates", "outcome_shares"])
def test_results_read_no_vectors_again(spark, name):
    plan = st.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan
