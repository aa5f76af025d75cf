import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import matching as mt
from fieldloom.llm import mixing as mx
from fieldloom.llm import packing as pk
from fieldloom.llm import tokens as tk


#: An instrument shows itself by names that abbreviate its word in two rows or more.
MATCH_ROWS = [
    (1, "a", "vevameveb.cimt.bp", "Vevameveb Panel item 3 - carotid wall thickness / before pregnancy"),
    (2, "b", "VvmvbCimtBp", "From the Vevameveb Panel: what was your carotid wall thickness prior to being pregnant?"),
    (3, "b", "VvmvbCimtBp", "From the Vevameveb Panel: what was your carotid wall thickness prior to being pregnant?"),
    (4, "c", "veva_cimt_ch", "Carotid wall thickness in childhood (Vevameveb)"),
    (5, "c", "veva.cimt.3", "Vevame. item 3 - carotid wall thickness"),
    (6, "d", "vvmvb_cimt_bp", "Carotid wall thickness before pregnancy (Vevamveb)"),
    (7, "d", "koto_cimt_bp", "Carotid wall thickness before pregnancy (Kotomiviv)"),
    (8, "a", "veva_head_bp", "Recurrent headache before pregnancy (Vevameveb)"),
    (9, None, "veva_head_bp", "Recurrent headache before pregnancy (Vevameveb)"),
    (10, "e", None, None),
    (11, "e", "xx", ""),
    (12, "e", "vvmvbcimtbp", "Carotid wall thickness as recorded with Vevameveb"),
]


def test_matching(spark):
    df = spark.createDataFrame([(*r, 1) for r in MATCH_ROWS], "ref_id long, dictionary_name string, variable_name string, description string, confidence int")
    out = mt.match(df)
    assert sorted((r.a, r.b) for r in out.collect()) == [(1, 2), (1, 3), (1, 5), (1, 6), (1, 12), (2, 5), (2, 6), (2, 12), (3, 5), (3, 6), (3, 12), (5, 6), (5, 12), (6, 12)]
    assert out.where("confidence <= 0 or confidence > 1").count() == 0
    assert mt.match(df.limit(0)).count() == 0


def test_matching_ordinary_names(spark):
    """Instruments that no one listed: names alone, names of other shapes, and periods that one side leaves out."""
    rows = [
        (1, "a", "phq9_1", "PHQ-9 item 1"), (2, "b", "PHQ9.1", "PHQ-9: little interest"), (3, "b", "phq9_2", "PHQ-9 item 2"), (4, "a", "bmi", "Body mass index"), (5, "b", "BMI_bl", "Body mass index at baseline"), (6, "c", "bmi_f1", None),
        (7, "a", "sf36_pf01", "Vigorous activities"), (8, "c", "sf36.pf01", "Limits in vigorous activities"), (9, "c", "sf36.pf02", "Moderate activities"), (10, "b", "q17", "Vigorous activities"), (11, "a", "age", "Age"), (12, "a", "age", "Age"),
        (13, "d", "smoking_now", "Current smoker"), (14, "e", "smoking_ever", "Ever smoker"),
    ]
    df = spark.createDataFrame(rows, "ref_id long, dictionary_name string, variable_name string, description string")
    got = {(r.a, r.b): r.confidence for r in mt.match(df).collect()}
    assert set(got) == {(1, 2), (4, 5), (4, 6), (7, 8), (7, 10), (8, 10)}


def test_matching_sends_nothing_through_the_driver(spark):
    """No join of any job broadcasts: sides grow with the rows, and Spark weighs them before words are exploded."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    df = spark.createDataFrame(MATCH_ROWS, "ref_id long, dictionary_name string, variable_name string, description string")
    assert len(mt.match(df).collect()) == 14
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [x.physicalPlanDescription() for x in (store.executionsList().apply(i) for i in range(before, store.executionsCount()))]
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]


def test_units_count_in_confidence(spark):
    rows = [(r[0], r[1], r[2], r[3], {2: "mm", 3: "cm"}.get(r[0]), "mm" if r[0] == 1 else None) for r in MATCH_ROWS]
    df = spark.createDataFrame([(a, b, c, d, e or f, 5) for a, b, c, d, e, f in rows], "ref_id long, dictionary_name string, variable_name string, description string, units string, n_codes int")
    got = {(r.a, r.b): r.confidence for r in mt.match(df).collect()}
    assert got[1, 3] == round(got[1, 2] * mt.DIFFERS, 4) or abs(got[1, 3] - got[1, 2] * mt.DIFFERS) < 2e-4


def test_periods_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "a", "bmi_t9", "Index"), (2, "b", "bmi", "Index in the ninth wave"), (3, "c", "bmi_t8", "Index")], "ref_id long, dictionary_name string, variable_name string, description string")
    got = {(r.a, r.b) for r in mt.match(df, periods={"t9": ("in the ninth wave",), "t8": ("in the eighth wave",)}).collect()}
    assert got == {(1, 2)}


def docs(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(i, ["a", "b", "c"][int(rng.integers(3))], " ".join(rng.choice(words, int(rng.integers(3, 120))))) for i in range(n)]
    return rows + [(n, "a", None), (n + 1, "b", ""), (n + 2, None, "no source"), (n + 3, "c", "long " * 3000), (0, "a", "again the same id")]


def test_packing_holds_every_token(spark):
    rows = docs(spark)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, slot int")
    kinds = {"s": 256, "m": 1024}
    out = pk.pack(df, kinds).cache()
    size = {}
    for i, _, t in rows:
        if t:
            size[i] = size.get(i, 0) + tk.count(t)
    for kind, cap in kinds.items():
        part = out.where(F.col("kind") == kind)
        assert part.groupBy("container").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= cap
        assert {r.id: r.n for r in part.groupBy("id").agg(F.sum("n").alias("n")).collect()} == size
        assert part.groupBy("container", "slot").count().where("count > 1").count() == 0
        split = part.groupBy("id").agg(F.max("part").alias("p")).where("p > 0")
        assert {r.id for r in split.collect()} == {i for i, n in size.items() if n > cap and i != 0}
    assert all(r.filled > 0.9 for r in pk.report(out, kinds).collect())
    assert pk.pack(df.limit(0), kinds).count() == 0


def test_windows_hold_neighbours(spark, monkeypatch):
    """Texts of one topic share windows, across many shards and rounds; chance would give a tenth."""
    monkeypatch.setattr(pk, "SHARD_ROWS", 150)
    rng = np.random.default_rng(7)
    topics = [[f"{chr(97 + t)}{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(60)] for t in range(10)]
    common = [f"zz{chr(97 + i)}" for i in range(20)]
    topic = {i: int(rng.integers(10)) for i in range(1200)}
    rows = [(i, " ".join([*rng.choice(topics[t], int(rng.integers(8, 30))), *rng.choice(common, 8)])) for i, t in topic.items()]
    out = pk.pack(spark.createDataFrame(rows, "doc_id long, text string"), {"s": 512}).collect()
    windows = {}
    for r in out:
        windows.setdefault(r.container, []).append(topic[r.id])
    pairs = [(w[0], x) for w in windows.values() for x in w[1:]]
    assert len(out) == 1200 and sum(a == b for a, b in pairs) / len(pairs) > 0.5


def test_index_scores_are_bm25():
    """The nearest text that fits follows the seed."""
    words = [np.array(w, np.int32) for w in ([1, 2, 3], [1, 9], [2, 3, 4], [7], [])]
    counts = [np.ones(len(w), np.int32) for w in words]
    df = np.zeros(pk.BUCKETS, np.int32)
    df[[1, 2, 3, 4, 7, 9]] = 2
    assert pk.fill(np.array([60, 30, 30, 10, 10]), words, counts, pk._idf(df, 1000), 100)[0] == [0, 2, 4]
    assert pk.fill(np.zeros(0, int), [], [], pk._idf(df, 1000), 100) == []


def test_texts_count_once(spark):
    """A text longer than every capacity counts once in the frequencies."""
    df = spark.createDataFrame([(1, "alpha " * 3000 + "beta"), (2, "beta gamma"), (3, "gamma")], "doc_id long, text string")
    n, corpus = pk.frequencies(pk.parts(df, [64, 256], "doc_id", "text", tk.VOCABULARY))
    at = {w: int(pk._words([w])[0][0][0]) for w in ("alpha", "beta", "gamma")}
    assert corpus == 3 and [n[at[w]] for w in ("alpha", "beta", "gamma")] == [1, 2, 2]


def test_mixing_reaches_shares(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", "c"][int(rng.choice(3, p=[0.8, 0.17, 0.03]))], int(rng.integers(1, 400))) for i in range(3000)] + [(9000, None, 5), (9001, "a", 0), (9002, "zz", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int")
    targets = spark.createDataFrame([("x", "a", 0.5, 2), ("x", "b", 0.3, 2), ("x", "c", 0.2, 2), ("y", "a", 0.0, 3), ("y", "b", 1.0, 3)], "mix_name string, source string, target_share double, max_repeats int")
    out = mx.mix(df, targets).cache()
    for r in mx.shares(out, targets).collect():
        assert abs(r.reached_share - r.target_share) < 0.001 and r.most_copies <= (2 if r.mix_name == "x" else 3)
    assert out.where("source = 'c' and mix_name = 'x'").agg(F.min("copies")).first()[0] == 2  # the scarce source is used up
    assert mx.mix(df.limit(0), targets).count() == 0


def test_source_without_documents(spark):
    """It has no rows and a reached share of 0; the others keep their proportions."""
    df = spark.createDataFrame([(i, "ab"[i % 2], 10 + i % 7) for i in range(400)], "doc_id long, source string, n int")
    targets = spark.createDataFrame([("x", "a", 0.3, 2), ("x", "b", 0.3, 2), ("x", "none", 0.4, 2)], "mix_name string, source string, target_share double, max_repeats int")
    got = {r.source: r for r in mx.shares(mx.mix(df, targets), targets).collect()}
    assert got["none"].documents == 0 and got["none"].reached_share == 0 and abs(got["a"].reached_share - 0.5) < 0.01


def test_long_text_in_pieces():
    t = "word " * 60_000 + "x" * 150_000
    assert "".join(tk.pieces(t)) == t and tk.count(t) > 60_000 and tk.count("") == 0
