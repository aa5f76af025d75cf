"""One form for texts that look the same.

1. Compatibility normalization, but raised and lowered signs stay, since they look
   different; ignorable characters are deleted; kinds of blank and of hyphen become one.
2. Each word becomes a lattice: every letter may be any letter of its shape (Latin,
   Greek or Cyrillic). Viterbi picks the path of the best score: character bigrams
   counted over all words of one script, and a cost for each change of script.

A lattice depends only on what a word looks like, so words that look the same come
out equal; and every path looks like its word, so words that look different stay so.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.runtime import fresh, stage

# Letters of one shape: Latin, Greek, Cyrillic ('-' where a script has none).
_SHAPES = """
a-а c-с e-е h-һ i-і j-ј o ο о p-р q-ԛ s-ѕ w-ԝ x-х y-у d-ԁ vνѵ uυ- l-ӏ
A Α А B Β В C-С E Ε Е H Η Н I Ι І J-Ј K Κ К M Μ М N Ν- O Ο О P Ρ Р S-Ѕ T Τ Т X Χ Х Y Υ Ү Z Ζ- Q-Ԛ W-Ԝ
-ΓГ -ΠП -ΦФ -κк
"""
#: Letters that look like another of their own script.
OWN_SCRIPT = str.maketrans("ɡɑ", "ga")
HYPHENS = "‐‑⁃﹣−֊"
SCRIPTS = "LGC"
CHANGE = 12.0  # cost of a change of script inside a word
AWAY = 8.0  # cost of a word in another script than most letters of its text that have no look-alike
#: Distinct words kept with their form in a worker, as many as fit a small memory.
CACHE = 200_000


def _shape_table() -> dict[str, dict[str, str]]:
    """For each letter that has a look-alike: script to letter."""
    out: dict[str, dict[str, str]] = {}
    for group in regex.findall(r"\S ?\S ?\S", _SHAPES):
        parts = group.replace(" ", "")
        if len(parts) != 3:
            continue
        options = {s: c for s, c in zip(SCRIPTS, parts, strict=True) if c != "-"}
        for c in options.values():
            out[c] = options
    return out


SHAPES = _shape_table()
_IGNORE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}᠎]")
_BLANK = regex.compile(r"[\p{Zs}]")
_HYPHEN = regex.compile(f"[{HYPHENS}]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")


_FIXED = {s: regex.compile(rf"[\p{{Script={n}}}--[{''.join(SHAPES)}]]", regex.V1) for s, n in zip(SCRIPTS, ("Latin", "Greek", "Cyrillic"), strict=True)}


def _keeps(c: str) -> bool:
    """Signs whose compatibility form looks different: raised, lowered, fractions, circled, squared and the like."""
    d = unicodedata.decomposition(c)
    return d.startswith(("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<small>"))


def plain(text: str) -> str:
    """Step 1. ASCII texts are their own plain form."""
    if text.isascii():
        return text
    out = _IGNORE.sub("", text).translate(OWN_SCRIPT)
    out = "".join(c if c < "\x80" or _keeps(c) else unicodedata.normalize("NFKD", c) for c in out)
    out = _HYPHEN.sub("-", _BLANK.sub(" ", out))
    return unicodedata.normalize("NFC", out)


def script(c: str) -> str:
    base = unicodedata.normalize("NFD", c)[0]
    o = ord(base)
    if base.isalpha():
        if o < 0x250 or 0x1E00 <= o < 0x1F00:
            return "L"
        if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
            return "G"
        if 0x400 <= o < 0x530:
            return "C"
    return "-"


def home(text: str) -> str:
    """The script of most letters of a plain text that have no look-alike; '-' where there are none."""
    if text.isascii():
        return "L" if _FIXED["L"].search(text) else "-"
    bare = unicodedata.normalize("NFD", text)  # a letter with an accent has the look-alikes of the bare one
    counts = {s: len(p.findall(bare)) for s, p in _FIXED.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "-"


class Lattice:
    """Words to their form, under bigram counts {(script, first, second): count}."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        totals: dict[tuple[str, str], int] = {}
        for (s, a, _), n in counts.items():
            totals[s, a] = totals.get((s, a), 0) + n
        self.scores = {k: math.log((n + 0.1) / (totals[k[0], k[1]] + 10)) for k, n in counts.items()}
        self.rest = {k: math.log(0.1 / (n + 10)) for k, n in totals.items()}
        self.words: dict[str, str] = {}  # by script of the text and word

    def _score(self, s: str, a: str, b: str) -> float:
        return self.scores.get((s, a, b), self.rest.get((s, a), -4.7))

    def word(self, w: str, home: str = "-") -> str:
        out = self.words.get(home + w)
        if out is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            out = self.words[home + w] = self._viterbi(w, home)
        return out

    def _viterbi(self, w: str, home: str) -> str:
        letters = unicodedata.normalize("NFD", w)
        if not any(c in SHAPES for c in letters):
            return unicodedata.normalize("NFC", letters)
        # Paths end in a script; ties go to the script that comes first, so they depend on shapes alone.
        paths: dict[str, tuple[float, str, str]] = {}
        for c in letters:
            if unicodedata.combining(c):
                paths = {s: (v, p + c, last) for s, (v, p, last) in paths.items()} or {"-": (0.0, c, "^")}
                continue
            options = SHAPES.get(c) or {script(c): c}
            if not paths:
                paths = {s: (self._score(s, "^", x) - (AWAY if s != home else 0.0), x, x) for s, x in options.items()}
                continue
            nxt: dict[str, tuple[float, str, str]] = {}
            for s, x in options.items():
                best = None
                for t in (*SCRIPTS, "-"):
                    if t in paths:
                        v, p, last = paths[t]
                        v += self._score(s, last if t == s else "^", x) - (CHANGE if t != s and "-" not in (s, t) else 0.0)
                        if best is None or v > best[0]:
                            best = (v, p + x, x)
                nxt[s] = best
            paths = nxt
        ends = [(v + self._score(s, last, "$"), -(*SCRIPTS, "-").index(s), p) for s, (v, p, last) in paths.items()]
        return unicodedata.normalize("NFC", max(ends)[2])

    def text(self, text: str) -> str:
        text = plain(text)
        at = home(text)
        return _WORD.sub(lambda m: self.word(m[0], at), text)


def bigrams(df: DataFrame, columns: list[str]) -> DataFrame:
    """(script, first, second, n) over the words of all texts whose letters are of one script, word edges as ^ and $."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str, str], int] = {}
        for batch in batches:
            words: dict[str, int] = {}
            for column in batch.columns:
                for text in column.to_pylist():
                    if text:
                        for w in _WORD.findall(plain(text)):
                            words[w] = words.get(w, 0) + 1
            for w, n in words.items():
                letters = unicodedata.normalize("NFD", w)
                kinds = {script(c) for c in letters if not unicodedata.combining(c)}
                if len(kinds) != 1 or kinds == {"-"}:
                    continue
                s, bare = kinds.pop(), [c for c in letters if not unicodedata.combining(c)]
                for a, b in zip(["^", *bare], [*bare, "$"], strict=True):
                    counts[s, a, b] = counts.get((s, a, b), 0) + n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([counts[k] for k in keys], pa.int64())], names=["script", "first", "second", "n"])

    return df.select(*columns).mapInArrow(run, "script string, first string, second string, n long").groupBy("script", "first", "second").agg(F.sum("n").alias("n"))


def one_form(df: DataFrame, columns: list[str], forms: list[str]) -> DataFrame:
    """``df`` with the form of each text column under the names in ``forms`` (which must be free).

    Nulls stay null and empty texts empty. The bigram table has at most the square of
    the letters of three alphabets, so it is sent to every task.
    """
    table = bigrams(df, columns).where(F.col("script").isin(*SCRIPTS)).collect()
    counts = {(r["script"], r["first"], r["second"]): r["n"] for r in table}
    shared = df.sparkSession.sparkContext.broadcast(counts)
    names = [f.name for f in df.schema]
    schema = T.StructType([*df.schema.fields, *(T.StructField(f, T.StringType()) for f in forms)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            out = []
            for c in columns:
                out.append(pa.array([None if t is None else lattice.text(t) for t in batch.column(names.index(c)).to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*names, *forms])

    return df.mapInArrow(run, schema)


def same_look_pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(row_id_a, row_id_b, field_name), smaller first: rows whose texts in a field look the same but differ.

    Texts are first brought together by form; only forms written in more than one way
    go on, so rows that agree in every character never meet. Null texts look like
    nothing. Repeated rows each form their own pairs, as asked for.
    """
    base = df.select(F.col(key).alias("id"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(columns)))
    texts, forms = [f"t{i}" for i in range(len(columns))], [f"f{i}" for i in range(len(columns))]
    formed = one_form(base, texts, forms)
    # Texts and forms as digests of 128 bits: what moves is small however long a text is.
    digest = lambda c: F.struct(F.xxhash64(c).alias("x"), F.xxhash64(F.reverse(c), F.lit(1)).alias("y"))
    cells = formed.select(
        "id",
        F.inline(F.array(*(F.struct(F.lit(i).alias("at"), digest(F.col(f)).alias("form"), digest(F.col(t)).alias("text"), F.col(t).isNotNull().alias("is")) for i, (t, f) in enumerate(zip(texts, forms, strict=True))))),
    ).where("is").drop("is")
    cells = stage(cells, "looks")
    written = cells.groupBy("at", "form").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("at", "form")
    some = stage(cells.join(written, ["at", "form"]), "variants")
    # Pairs of texts first, then their rows: rows of the same text never meet.
    texts = stage(some.select("at", "form", "text").distinct(), "texts")
    pairs = texts.withColumnRenamed("text", "ta").join(texts.withColumnRenamed("text", "tb"), ["at", "form"]).where("ta < tb").drop("form")
    rows = some.select("at", "id", "text")
    found = pairs.join(rows.withColumnsRenamed({"id": "a", "text": "ta"}), ["at", "ta"]).join(rows.withColumnsRenamed({"id": "b", "text": "tb"}), ["at", "tb"])
    name = F.element_at(F.array(*(F.lit(c) for c in columns)), F.col("at") + 1)
    return found.select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"), name.alias("field_name"))


def spelled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_form`` for each column (underscores before it where the name is taken)."""
    return one_form(df, columns, fresh(df, *(f"{c}_form" for c in columns)))
