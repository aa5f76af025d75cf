import json

import pytest

from fieldloom.sources import readers as rd
from fieldloom.sources import writers as wr
from fieldloom.streaming import deliveries as dv


def test_read_dictionary(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Variable,Field Label,Type,Unit,Note\nage,"Age, in\nyears",int,years,x\nsex,NA,,n/a,\n', encoding="utf-8")
    rows = rd.read_dictionary(spark, str(p), "c1").orderBy("ord").collect()
    assert [(r.variable_name, r.description, r.data_type, r.units, r.metadata) for r in rows] == [("age", "Age, in\nyears", "int", "years", {"Note": "x"}), ("sex", None, None, None, {})]
    t = tmp_path / "b.txt"
    t.write_text("name|definition\nx|one\n")
    assert rd.read_dictionary(spark, str(t), "c").first().description == "one"
    bad = tmp_path / "c.csv"
    bad.write_text("p,q\n1,2\n")
    with pytest.raises(ValueError):
        rd.read_dictionary(spark, str(bad), "c")


def test_roles_are_greedy():
    assert rd.detect_roles(["field_name", "variable_name", "description"]) == {"variable_name": "variable_name", "description": "description"}
    assert rd.detect_roles(["x", "label"], {"variable_name": "x"}) == {"variable_name": "x", "description": "label"}


def test_catalog_and_xml(spark, tmp_path):
    rec = {"tinyId": "t1", "designations": [{"designation": "Age", "tags": []}, {"designation": "How old?", "tags": ["Preferred Question Text"]}], "definitions": [{"definition": "d"}], "valueDomain": {"datatype": "Value List", "permissibleValues": [{"permissibleValue": "1", "valueMeaningName": "Yes", "valueMeaningCode": "C1", "codeSystemName": "S"}, {"permissibleValue": "2", "valueMeaningName": "No"}]}}
    (tmp_path / "c.json").write_text(json.dumps([rec, {"tinyId": "t2"}]))
    a, b = rd.read_catalog(spark, str(tmp_path / "c.json")).orderBy("tinyid").collect()
    assert (a.designation, a.question_text, a.permissible_values, a.concept_codes) == ("Age", "How old?", "1=Yes|2=No", "S:C1") and b.designation is None
    (tmp_path / "v.xml").write_text('<t><variable id="p1"><name>age</name><type>int</type><value code="1">Yes</value><value code="2">No</value></variable><variable id="p2"><name> </name></variable></t>')
    (v,) = rd.read_variable_xml(spark, str(tmp_path / "v.xml")).collect()
    assert (v.field_id, v.variable_name, v.value_encoding) == ("p1", "age", "1=Yes|2=No")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "adopt", 0.9), ("b", "refine", 0.5), ("c", "novel", None)], "k string, verdict string, cos double")
    assert [r.k for r in wr.review_order(df).collect()] == ["b", "c", "a"]
    wr.write_review_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    with pytest.raises(ValueError):
        wr.write_review_csv(spark.createDataFrame([("a\nb",)], "k string"), str(tmp_path / "bad"))
    wr.write_buckets(df, str(tmp_path / "buckets"), "verdict")
    wr.write_jsonl(df, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 3
    el = spark.createDataFrame([("t", "Age", "d", None, None, "1=Yes|2=No")], "tinyid string, designation string, definition string, datatype string, uom string, permissible_values string")
    doc = json.loads(wr.element_documents(el).first().document)
    assert doc["valueDomain"]["permissibleValues"][1] == {"permissibleValue": "2", "valueMeaningName": "No"}
    cache = spark.createDataFrame([("m", "h1", "semantic")], "model string, content_hash string, vector_type string")
    new = spark.createDataFrame([("m", "h1", "semantic"), ("m", "h2", "semantic"), ("m", "h2", "semantic")], cache.schema)
    assert wr.put_vectors(cache, new).count() == 1
    prompts = spark.createDataFrame([("1", "p"), ("2", "q")], "id string, prompt string")
    answers = spark.createDataFrame([("1", "yes")], "id string, response string")
    assert rd.with_answers(prompts, answers).where("response is null").count() == 1 and rd.unanswered(prompts, answers).first().id == "2"


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select id % 5 as k, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id * 10) as at from range(600)").union(spark.sql("select 0L, timestamp'2024-03-01'")).write.parquet(src)
    s = dv.read_deliveries(spark, src, "k long, at timestamp")
    dv.run_available(dv.per_window(s, "at", "k", "1 day", "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.agg({"n": "sum"}).first()[0] == 600 and out.count() == 25
    once = dv.once(dv.read_deliveries(spark, src, "k long, at timestamp"), ["k"], "at")
    dv.run_available(once, str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 5


def test_documents(spark, tmp_path):
    import io
    import zipfile

    from fieldloom.sources import documents as dc

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    files = {"a.txt": "caf\u00e9\r\n\r\n\r\n x  y ".encode(), "b.txt": "caf\u00e9".encode("cp1252"), "c.html": b"<html><head><title>t</title></head><p>A &amp; B</p><table><tr><td>1</td><td>2</td></tr></table><script>x()</script></html>", "d.docx": buffer.getvalue(), "e.pdf": b"%PDF-1.4", "f.docx": b"PK\x03\x04broken", "g.txt": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in dc.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("caf\u00e9\n\nx y", None) and got["b.txt"] == ("caf\u00e9", None) and got["c.html"] == ("A & B\n1 | 2", None) and got["d.docx"] == ("One two\na | b", None)
    assert got["e.pdf"][0] is None and got["f.docx"][1].startswith("broken") and "g.txt" not in got
