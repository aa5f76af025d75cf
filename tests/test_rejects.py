from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.operators import rejects as rj

FILES = [("f.csv", ",", "variable_name,description,n_codes,value_encoding"), ("g.txt", "|", "variable_name|value_encoding")]


def parsed(spark, rows):
    lines = spark.createDataFrame(rows, "line_id long, file_name string, raw_line string, delimiter string, extra int")
    files = spark.createDataFrame(FILES, "file_name string, delimiter string, header string")
    return rj.parse_records(lines, files)


def test_reasons_in_order(spark):
    rows = [
        (1, "f.csv", 'age,"Age, years",2,1=Yes|2=No', "x", 1),
        (2, "f.csv", 'age,"Age "x" years",2,', "x", 1),
        (3, "f.csv", "age,Age,2", "x", 1),
        (4, "f.csv", "1age,Age,2,", "x", 1),
        (5, "f.csv", "age,Age,two,", "x", 1),
        (6, "f.csv", "age,Age,,1=Yes|1=No", "x", 1),
        (7, "f.csv", "age,Age,,1=Yes|", "x", 1),
        (8, "g.txt", 'a.b_1|"1=Yes|2=No"', "x", 1),
        (9, "f.csv", None, "x", 1),
        (10, "none.csv", "a,b", "x", 1),
        (11, "f.csv", "", "x", 1),
        (12, "f.csv", ' age ,"two\nlines",,', "x", 1),
        (13, "f.csv", 'age,un\nquoted,"","1=a=b|2= c "', "x", 1),
        (13, "f.csv", 'age,un\nquoted,"","1=a=b|2= c "', "x", 1),
    ]
    out = parsed(spark, rows)
    got = sorted((r.line_id, r.reason) for r in out.collect())
    assert got == [(1, None), (2, "quoting"), (3, "column_count"), (4, "invalid_value"), (5, "invalid_value"), (6, "invalid_value"), (7, "invalid_value"), (8, None), (9, "column_count"), (10, "unknown_file"), (11, "column_count"), (12, None), (13, None), (13, None)]
    good = {r.line_id: r for r in rj.loaded(out, ["variable_name", "description", "n_codes", "value_encoding"]).collect()}
    assert good[1].description == "Age, years" and good[1].n_codes == 2
    assert good[12].variable_name == "age" and good[12].description == "two\nlines"
    assert good[13].description == "un\nquoted" and good[13].value_encoding == "1=a=b|2= c"
    assert {r.line_id: r.failing for r in rj.rejected(out).collect()}[5] == ["n_codes"]


def test_empty_and_long(spark):
    assert parsed(spark, []).count() == 0
    long = "x" * 3_000_000
    r = parsed(spark, [(1, "f.csv", f'a,"{long}",,', "", 0)]).first()
    assert r.reason is None and len(r.cells["description"]) == 3_000_000


def split_slow(record, d):
    """Cells of a record, or None for bad quoting: one character at a time."""
    cells, i = [], 0
    while True:
        if record[i : i + 1] == '"':
            j, cell = i + 1, ""
            while True:
                k = record.find('"', j)
                if k < 0:
                    return None
                cell += record[j:k]
                if record[k + 1 : k + 2] == '"':
                    cell, j = cell + '"', k + 2
                    continue
                i = k + 1
                break
            if i < len(record) and record[i] != d:
                return None
        else:
            k = record.find(d, i)
            cell = record[i:] if k < 0 else record[i:k]
            if '"' in cell:
                return None
            i = len(record) if k < 0 else k
        cells.append(cell)
        if i >= len(record):
            return cells
        i += 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n\r =|', max_size=14), min_size=1, max_size=6))
def test_blocks_match_brute_force(records):
    names = ["p", "q", "r"]
    why, cells = rj.read_block(records, ",", names)
    for i, rec in enumerate(records):
        want = split_slow(rec, ",")
        if want is None:
            assert why[i] == "quoting"
        elif len(want) != 3:
            assert why[i] == "column_count"
        else:
            assert why[i] is None and [cells[n][i] for n in names] == want


def test_all_cells_by_role(spark):
    files = spark.createDataFrame([("a", ",", "variable_name,form_name,field_label,field_type,value_encoding,n_codes"), ("b", ";", "variable_name;description;codelist_name;n_codes")], "file_name string, delimiter string, header string")
    lines = spark.createDataFrame([(1, "a", "x,F,Label,radio,1=Yes|2=No,2"), (2, "b", "y;Text;L;"), (3, "b", "y;;;"), (4, "b", "1y;;;")], "line_id long, file_name string, raw_line string")
    got = {r.line_id: r for r in rj.by_role(rj.parse_records(lines, files), files).collect()}
    assert sorted(got) == [1, 2, 3]
    a, b, c = got[1], got[2], got[3]
    assert (a.variable_name, a.category, a.description, a.data_type, a.value_encoding, a.n_codes, a.other) == ("x", "F", "Label", "radio", "1=Yes|2=No", 2, '{"field_label":"Label"}')
    assert (b.description, b.n_codes) == ("Text", None) and "L" in (b.value_encoding or "") + b.other and (c.description, c.other) == (None, "{}")
