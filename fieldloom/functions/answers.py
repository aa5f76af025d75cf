"""Answers of a model: the JSON object in a text that may wrap it in prose or fences, and what stages read from it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def find_object(text: str | None) -> str | None:
    """The widest JSON object of ``text`` as JSON, first of a fenced part if there is one; null where there is none.

    An object that wraps the answer as text under ``content`` is opened.
    """
    if not text:
        return None
    fenced = _FENCED.search(text)
    t = (fenced[1] if fenced else text).strip()
    decoder, best, width, i = json.JSONDecoder(), None, -1, t.find("{")
    while i >= 0:
        try:
            value, end = decoder.raw_decode(t, i)
        except ValueError:
            i = t.find("{", i + 1)
            continue
        if end - i > width:
            best, width = value, end - i
        i = t.find("{", end)  # what lies inside is narrower
    if isinstance(best, dict) and isinstance(best.get("content"), str) and len(best) == 1:
        return find_object(best["content"])
    return None if best is None else json.dumps(best, ensure_ascii=False)


def find_items(text: str | None, key: str | None = None) -> list[str]:
    """The complete objects of the list under ``key`` (else of the first list), even where the text ends inside it."""
    if not text:
        return []
    fenced = _FENCED.search(text)
    t = fenced[1] if fenced else text
    opened = re.search(rf'"{re.escape(key)}"\s*:\s*\[', t) if key else None
    i = opened.end() if opened else t.find("[") + 1
    if i <= 0:
        return []
    decoder, out = json.JSONDecoder(), []
    while i < len(t):
        if t[i] == "]":
            break
        if t[i] != "{":
            i += 1
            continue
        try:
            value, i = decoder.raw_decode(t, i)
        except ValueError:  # cut off, or broken: go on behind its end, if it has one
            depth, quoted, j = 0, False, i
            while j < len(t):
                c = t[j]
                if quoted:
                    j += c == "\\"
                    quoted = c != '"'
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        break
                j += 1
            i = j + 1
            continue
        out.append(json.dumps(value, ensure_ascii=False))
    return out


def payloads(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, payload): the object of each answer as JSON text; null where it holds none."""
    kind = dict(answers.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([find_object(t) for t in b.column(1).to_pylist()], pa.string())], names=[key, "payload"])

    return answers.select(key, text).mapInArrow(run, f"{key} {kind}, payload string")


def number(text: Column) -> Column:
    """The first whole number in a text."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def ranking(payload: Column, n: Column) -> Column:
    """Places from 1 under ``ranking`` that are at most ``n``, each once, in their order."""
    listed = F.from_json(F.get_json_object(payload, "$.ranking"), "array<string>")
    places = F.transform(F.coalesce(listed, F.array().cast("array<string>")), number)
    return F.array_distinct(F.filter(places, lambda p: (p >= 1) & (p <= n)))


def clamped(payload: Column, path: str) -> Column:
    """A number of the payload in [0, 1]; 0 where it isn't one."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get_json_object(payload, path).try_cast("double"))), F.lit(0.0))


def is_yes(payload: Column, path: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.get_json_object(payload, path))).isin("true", "yes", "1"), F.lit(False))
