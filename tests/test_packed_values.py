import pytest

from fieldloom.operators import packed_values as pv

CASES = [
    ("1=Yes|2=No", ["1=Yes", "2=No"]),
    (" 1=Male; 2=Female | 3=Other\n4=None ", ["1=Male", "2=Female", "3=Other", "4=None"]),
    ("1=Employed, full time, 2=Employed, part time", ["1=Employed, full time", "2=Employed, part time"]),
    ("1=Less than $10,000,2=$10,000 to $24,999", ["1=Less than $10,000", "2=$10,000 to $24,999"]),
    ('"Answered ""none""","Other, specify",Skipped', ['Answered "none"', "Other, specify", "Skipped"]),
    ("'Yes', 'No'", ["Yes", "No"]),
    ('1=Answered "none"|2=Answered "some"', ['1=Answered "none"', '2=Answered "some"']),
    ("EDU_1, Never|EDU_m9, Missing", ["EDU_1, Never", "EDU_m9, Missing"]),
    ("(0) Tablet | (1) Injection (under the skin, weekly)", ["(0) Tablet", "(1) Injection (under the skin, weekly)"]),
    ("1=Yes||2=No|", ["1=Yes", "2=No"]),
    ("1=Yes;;2=No;", ["1=Yes", "2=No"]),
    ("Male/Female", ["Male", "Female"]),
    ("1. Never\r\n2. Former", ["1. Never", "2. Former"]),
    ("Asthma; Autoimmune condition (e.g., lupus); Other, specify", ["Asthma", "Autoimmune condition (e.g., lupus)", "Other, specify"]),
    ("1=A^2=B", ["1=A", "2=B"]),
    ('"Urban; see note";Rural', ["Urban; see note", "Rural"]),
]
SINGLE = ["mg/dL", "kg/m2", "mm/dd/yyyy", "n/a", "N/A", "integer, 3 digits", "Encoding table B, appendix", '"Other, specify"', "0.0-99.9", "1=Yes", "-9=MISSING", "see encoding 1002", "", " ", "|", "10^9/L", '"']


@pytest.mark.parametrize(("text", "want"), CASES)
def test_lists(text, want):
    assert pv.split_text(text) == want


@pytest.mark.parametrize("text", SINGLE)
def test_single_values(text):
    assert pv.split_text(text) == []


def test_table_matches_plain_python(spark):
    texts = [t for t, _ in CASES] + SINGLE + [None, "1=Yes|2=No", "|".join(f"{i}=label {i}" for i in range(20_000))]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "row_id int, value_encoding string, pos string")
    out = pv.split_packed(df, "value_encoding")
    assert out.columns == ["row_id", "value_encoding", "pos", "_pos", "item"]
    got = {(r.row_id, r._pos): r.item for r in out.select("row_id", "_pos", "item").collect()}
    want = {(i, k + 1): x for i, t in enumerate(texts) if t for k, x in enumerate(pv.split_text(t))}
    assert got == want
    assert pv.split_packed(df, "value_encoding", max_broadcast=0).count() == len(want)  # joined by a shuffle
    assert pv.split_packed(df.limit(0), "value_encoding").count() == 0
