"""Rows that fail to parse: reasons for rejects, typed columns for the rest.

Structure is judged by the CSV reader of pyarrow: records whose quoting holds are
read in blocks as strings and its invalid-row callback names those with a wrong
number of cells. Values are then checked as whole columns.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.dictionary import detect_roles
from fieldloom.runtime import broadcast_if_small, fresh

QUOTING, COLUMN_COUNT, INVALID_VALUE, UNKNOWN_FILE = "quoting", "column_count", "invalid_value", "unknown_file"
#: Records that are handed to the reader at once.
BLOCK_ROWS = 20_000
# A cell may hold line breaks with or without quotes, but the reader ends a record
# at each break outside quotes; these stand in for breaks while it reads.
_ESCAPE = str.maketrans({"\ue000": "\ue000\ue000", "\n": "\ue000\ue001", "\r": "\ue000\ue002", "\0": "\ue000\ue003"})
_BACK = {"\ue000": "\ue000", "\ue001": "\n", "\ue002": "\r", "\ue003": "\0"}
_BLANKS = " \t\n\r\v\f\u00a0\u2007\u202f\u3000"


def _unescape(text: str) -> str:
    return re.sub("\ue000([\ue000-\ue003])", lambda m: _BACK[m[1]], text)


def well_quoted(delimiter: str) -> re.Pattern:
    d = re.escape(delimiter)
    cell = rf'(?:"(?:[^"]|"")*+"|[^"{d}]*+)'
    return re.compile(rf"{cell}(?:{d}{cell})*+\Z")


def options_problem(text: str) -> bool:
    """Whether a trimmed, non-empty value encoding is no list of code=label entries with distinct codes."""
    seen = set()
    for entry in text.split("|"):
        code, eq, label = entry.partition("=")
        code = code.strip(_BLANKS)
        if not eq or not code or not label.strip(_BLANKS) or code in seen:
            return True
        seen.add(code)
    return False


def read_block(records: list[str], delimiter: str, names: list[str]) -> tuple[list[str | None], dict[str, list[str | None]]]:
    """Reasons (None for a good structure) and cells by column, both in the order of ``records``."""
    quoted = well_quoted(delimiter)
    reasons: list[str | None] = [None if quoted.match(r) else QUOTING for r in records]
    fine = [i for i, why in enumerate(reasons) if why is None]
    cells: dict[str, list[str | None]] = {n: [None] * len(records) for n in names}
    if not fine:
        return reasons, cells
    # The first cell is the record's place, so a reject can be told by its text.
    body = "\n".join(f"{i}{delimiter}{records[i].translate(_ESCAPE)}" for i in fine).encode("utf-8", "surrogatepass")

    def invalid(row: pacsv.InvalidRow) -> str:
        reasons[int(row.text.split(delimiter, 1)[0])] = COLUMN_COUNT
        return "skip"

    columns = ["#", *(f"c{k}" for k in range(len(names)))]
    read = pacsv.read_csv(
        io.BytesIO(body),
        read_options=pacsv.ReadOptions(column_names=columns, block_size=len(body) + 1, use_threads=False),
        parse_options=pacsv.ParseOptions(delimiter=delimiter, quote_char='"', double_quote=True, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(column_types={c: pa.string() for c in columns}, strings_can_be_null=False),
    )
    at = pc.cast(read.column("#"), pa.int64()).to_pylist()
    for k, name in enumerate(names):
        into = cells[name]
        for i, v in zip(at, read.column(f"c{k}").to_pylist(), strict=True):
            into[i] = _unescape(v) if "\ue000" in v else v
    return reasons, cells


def check_values(cells: dict[str, list[str | None]], reasons: list[str | None]) -> list[list[str]]:
    """Columns whose cell fails its type, for each record; sets ``invalid_value`` where there are any."""
    bad: list[list[str]] = [[] for _ in reasons]
    for name, test in (("variable_name", None), ("n_codes", None), ("value_encoding", options_problem)):
        if name not in cells:
            continue
        column = pc.utf8_trim(pa.array(cells[name], pa.string()), characters=_BLANKS)
        if name == "variable_name":
            wrong = pc.invert(pc.match_substring_regex(column, r"\A[A-Za-z][A-Za-z0-9_.]*\z")).to_pylist()
        elif name == "n_codes":
            wrong = pc.invert(pc.match_substring_regex(column, r"\A[0-9]*\z")).to_pylist()
        else:
            wrong = [v is not None and v != "" and test(v) for v in column.to_pylist()]
        for i, w in enumerate(wrong):
            if w and reasons[i] is None:
                bad[i].append(name)
    for i, names in enumerate(bad):
        if names:
            reasons[i] = INVALID_VALUE
    return bad


def parse_records(lines: DataFrame, files: DataFrame, *, key: str = "line_id", file: str = "file_name", record: str = "raw_line") -> DataFrame:
    """Each record of ``lines`` once, as (key, file, reason, failing, cells).

    ``files`` gives ``file_name``, ``delimiter`` and ``header`` for each file.
    ``reason`` is null for a good record, else the first that holds of ``quoting``,
    ``column_count`` and ``invalid_value`` (then ``failing`` names its columns);
    ``cells`` maps the columns of a good record to trimmed texts, empty ones null.
    A null record has no cells, so it is ``column_count``; a record of a file that
    ``files`` doesn't know is ``unknown_file``. Repeated records each keep their row;
    other columns of ``lines`` don't matter. Every record is judged on its own, so
    no file, however large, gathers in one task.
    """
    d, h = fresh(lines, "delimiter_", "header_")
    known = files.select(F.col("file_name").alias("file_"), F.col("delimiter").alias(d), F.col("header").alias(h)).dropDuplicates(["file_"])
    joined = lines.select(F.col(key).alias("key"), F.col(file).alias("file_name"), F.col(record).alias("record")).join(
        broadcast_if_small(known, 10_000), F.col("file_name") == F.col("file_"), "left"
    ).select("key", "file_name", "record", d, h)
    key_type = lines.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("file_name", T.StringType()),
            T.StructField("reason", T.StringType()),
            T.StructField("failing", T.ArrayType(T.StringType())),
            T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                record_, delim, header = (part.column(i).to_pylist() for i in (2, 3, 4))
                reasons: list[str | None] = [None] * len(record_)
                failing: list[list[str]] = [[] for _ in record_]
                cells: list[list[tuple[str, str | None]] | None] = [None] * len(record_)
                groups: dict[tuple[str, str], list[int]] = {}
                for i, text in enumerate(record_):
                    if delim[i] is None or header[i] is None:
                        reasons[i] = UNKNOWN_FILE
                    elif text is None:
                        reasons[i] = COLUMN_COUNT
                    else:
                        groups.setdefault((delim[i], header[i]), []).append(i)
                for (dl, hd), rows in groups.items():
                    names = hd.split(dl)
                    why, columns = read_block([record_[i] for i in rows], dl, names)
                    wrong = check_values(columns, why)
                    for n, i in enumerate(rows):
                        reasons[i], failing[i] = why[n], wrong[n]
                        if why[n] is None:
                            cells[i] = [(name, (columns[name][n] or "").strip(_BLANKS) or None) for name in names]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(reasons, pa.string()), pa.array(failing, pa.list_(pa.string())), pa.array(cells, pa.map_(pa.string(), pa.string()))],
                    names=["key", "file_name", "reason", "failing", "cells"],
                )

    return joined.mapInArrow(run, schema).withColumnsRenamed({"key": key, "file_name": file})


#: Kinds of header that ``by_role`` takes.
HEADERS = 10_000


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").drop("cells")


def loaded(parsed: DataFrame, columns: list[str]) -> DataFrame:
    """The good records with ``columns`` as columns; ``n_codes`` as a number."""
    keep = [c for c in parsed.columns if c not in ("reason", "failing", "cells")]
    as_column = lambda c: F.col("cells")[c].try_cast("int") if c == "n_codes" else F.col("cells")[c]
    return parsed.where("reason is null").select(*keep, *(as_column(c).alias(c) for c in columns))


def by_role(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """The good records with a column for each role that some file has, ``n_codes`` as a number, and all other cells in ``other`` as JSON.

    Roles are found from each header. A file's label stands in for a description that it
    lacks, and stays in ``other``. No cell is lost.
    """
    headers = files.select("delimiter", "header").distinct().limit(HEADERS + 1).collect()
    if len(headers) > HEADERS:
        raise ValueError(f"more than {HEADERS} kinds of header")
    columns: dict[str, list[str]] = {}
    for r in sorted(headers, key=lambda r: r["header"]):
        for role, column in detect_roles(r["header"].split(r["delimiter"])).items():
            if column not in columns.setdefault(role, []):
                columns[role].append(column)
    cells = F.col("cells")
    first = lambda role: F.coalesce(F.lit(None).cast("string"), *(cells[c] for c in columns.get(role, [])))
    roles = {role: first(role) for role in sorted(columns) if role not in ("field_id", "short_label")}
    roles["description"] = F.coalesce(first("description"), first("short_label"))
    used = {c for role in roles for c in columns.get(role, [])} | {"n_codes"}
    keep = [c for c in parsed.columns if c not in ("reason", "failing", "cells")]
    other = F.to_json(F.map_filter(cells, lambda k, v: v.isNotNull() & ~k.isin(*sorted(used))))
    return parsed.where("reason is null").select(*keep, *(c.alias(role) for role, c in roles.items()), cells["n_codes"].try_cast("int").alias("n_codes"), other.alias("other"))
