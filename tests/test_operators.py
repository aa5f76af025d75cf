import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import text as tx
from fieldloom.functions import values as vx
from fieldloom.operators import dictionary as dx
from fieldloom.operators import families as fx
from fieldloom.operators import groups as gx
from fieldloom.operators import retrieval as rx
from fieldloom.operators.graph import connected_components


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (None, 7)]
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in list(p)}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_closure_ends_on_cycles(spark):
    out = dx.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "p string, c string"), "p", "c")
    assert {r.descendant for r in out.where("ancestor = 'b'").collect()} == {"a", "b", "c", "d"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("(1) a|(2) b", [("1", "a"), ("2", "b")]), ("1=Yes|2=No", [("1", "Yes"), ("2", "No")]), ("X_1, A | X_2, B", [("X_1", "A"), ("X_2", "B")]), ("Yes/No", [("1", "Yes"), ("2", "No")]), ("a|b|c", [("1", "a"), ("2", "b"), ("3", "c")]), ("mg/dL", []), ("", []), (None, [])],
)
def test_parse_options(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "x string").select(vx.parse_options(F.coalesce("x", F.lit(""))).alias("o")).first().o
    assert [(x.code, x.label) for x in r] == want


def test_formulas(spark):
    df = spark.createDataFrame([(2.0, 8.0), (0.0, 1.0)], "a double, b double")
    got = [r.x for r in df.select(vx.compile_formula("max(a, 1) + b / a ** 2", {"a": F.col("a"), "b": F.col("b")}).alias("x")).collect()]
    assert got == [4.0, None]
    for bad in ("__import__('os')", "a.b", "c + 1", "'x'", "True + 1"):
        with pytest.raises(ValueError):
            vx.compile_formula(bad, {"a": F.col("a")})
    assert vx.formula_names("log(x) + y") == {"x", "y"}


def test_units_and_ordinal_fill(spark):
    df = vx.canonical_units(spark.createDataFrame([("KG",), (" cm ",), ("furlong",), (None,)], "u string"), "u")
    assert [r.canonical for r in df.orderBy("u").collect()] == [None, "cm", "kg", None] or {r.u: r.canonical for r in df.collect()} == {"KG": "kg", " cm ": "cm", "furlong": None, None: None}
    assert vx.ordinal_fill(["1", "2", "3"], ["0", "1", "2"], {"1": "0", "3": "2"}) == {"1": "0", "2": "1", "3": "2"}
    assert vx.ordinal_fill(["1", "2", "3"], ["0", "1", "2"], {"1": "2", "3": "0"}) is None


def test_recode(spark):
    df = spark.createDataFrame([("1",), ("5",), ("9",), ("x",), (None,)], "c string").select(vx.recode(F.col("c"), {"1,2": "a", "4:6": "b", "9": "NA"}, F.col("c")).alias("r"))
    assert [r.r for r in df.collect()] == ["a", "b", None, "x", None]


def test_text(spark):
    df = spark.createDataFrame([("fooBar_baz-2X", " a  b \tc ", "<p>Q: “How <b>old</b>?”</p>")], "n string, s string, h string")
    r = df.select(F.array_join(tx.words_of_name(F.col("n")), " ").alias("n"), tx.squeeze(F.col("s")).alias("s"), tx.clean(F.col("h")).alias("h"), tx.null_if_na(F.lit(" NaN ")).alias("na"), tx.strip_sentinels(F.lit("-9=Missing|1=Yes")).alias("st")).first()
    assert (r.n, r.s, r.h, r.na, r.st) == ("foo bar baz 2 x", "a b c", "Q: “How old ?”", None, "1=Yes")


def test_bm25_matches_plain_formula(spark):
    docs = {1: "red fox red", 2: "blue fox", 3: "green tree tall tree", 4: ""}
    d = spark.createDataFrame(list(docs.items()), "d int, text string")
    q = spark.createDataFrame([(7, "red fox fox"), (8, "nothing")], "q int, text string")
    got = {(r.q, r.d): r.score for r in rx.bm25_scores(q, d).collect()}
    toks = {k: v.split() for k, v in docs.items()}
    avg = sum(map(len, toks.values())) / 4
    want = {}
    for k, t in toks.items():
        s = 0.0
        for w in {"red", "fox"}:
            df = sum(w in x for x in toks.values())
            if w in t:
                s += np.log(1 + (4 - df + 0.5) / (df + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s:
            want[7, k] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_chunks_hold_the_cap(spark):
    rng = np.random.default_rng(0)
    rows = [(g, i + 1000 * g, rng.normal(size=8).tolist()) for g, n in ((0, 30), (1, 120), (2, 500)) for i in range(n)]
    out = gx.chunk(spark.createDataFrame(rows, "g int, k int, v array<double>"), "g", "k", "v", 45, block=200).groupBy("g", "chunk").count().collect()
    assert max(r["count"] for r in out) <= 45 and sum(r["count"] for r in out) == 650
    x = np.vstack([np.tile([1.0, 0.0], (3, 1)), np.tile([0.0, 1.0], (4, 1))])
    assert gx.two_parts(x).tolist() == [True] * 3 + [False] * 4


def test_large_groups_are_cut_by_similarity(spark):
    """Twelve tight families of 40 in a group above the block stay whole; copies of one vector are still cut."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 16))
    rows = [("g", i, (middle[i % 12] + rng.normal(size=16) * 0.05).tolist()) for i in range(480)] + [("same", 1000 + i, [1.0] * 16) for i in range(300)] + [(None, 2000 + i, [1.0] * 16) for i in range(5)]
    out = gx.chunk(spark.createDataFrame(rows, "g string, k int, v array<double>"), "g", "k", "v", 45, block=200).collect()
    assert len(out) == len(rows) == len({r.k for r in out})
    of = {}
    for r in out:
        if r.g == "g":
            of.setdefault(r.k % 12, set()).add(r.chunk)
    assert all(len(c) == 1 for c in of.values()) and len(set.union(*of.values())) == 12


def test_hierarchy_goes_five_levels_deep(spark, tmp_path):
    from fieldloom.plans import suite

    rows = [(i, "c", f"a, b, c, d, e, f, {i}") for i in range(2)] + [(2, "c", "a, b, x"), (3, "c", None), (4, "other", "a, b, c")]
    spark.createDataFrame(rows, "row_id int, cohort string, description string").write.parquet(f"{tmp_path}/dictionary_fields.parquet")
    got = suite.QUERIES["hierarchy_levels"](spark, str(tmp_path)).collect()
    assert sorted((r.row_id, r.level) for r in got) == sorted([(i, k) for i in range(2) for k in range(1, 6)] + [(2, 1), (2, 2)])
    assert {r.suffix for r in got if r.level == 5} == {"f, 0", "f, 1"}


def test_common_prefix_has_no_depth_limit(spark):
    df = spark.createDataFrame([("c", f"a_b_c_d_e_f_g_h_{x}") for x in ("k", "l", "m")], "cohort string, variable_name string")
    assert [(r.prefix, r.depth, r.n_fields) for r in dx.common_prefix(df).collect()] == [("a_b_c_d_e_f_g_h", 8, 3)]


def test_fuse_keeps_zero_scores(spark):
    a = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.0)], "q int, d int, score double")
    b = spark.createDataFrame([(1, 1, 0.0), (1, 2, 3.0), (1, 3, 0.0)], "q int, d int, score double")
    assert [r.d for r in rx.fuse(a, b, 2).orderBy("rank").collect()] == [1, 2]  # 1/61 + 1/62 each: a tie goes to the smaller id


def test_salvage_and_moves(spark):
    assert fx.salvage('x [{"a": {"b": 1}}, {"c": "}"}, {"cut": [1') == ['{"a": {"b": 1}}', '{"c": "}"}']
    assert fx.salvage("no { json") == []
    g = spark.createDataFrame([("m1", "g1"), ("m2", "g2")], "member string, `group` string")
    assert {(r.member, r.group, r.moved) for r in fx.moved_members(g, spark.createDataFrame([("m1", "g2")], "member string, to string")).collect()} == {("m1", "g2", True), ("m2", "g2", False)}
    with pytest.raises(ValueError):
        fx.moved_members(g, spark.createDataFrame([("m1", "g9")], "member string, to string"))
