"""Several values packed in one field, split into one row per value.

1. Every text is cut into tokens: runs of ordinary characters, and single signs. Its
   skeleton is the sequence of token classes, so texts that differ only in ordinary
   characters share one.
2. Splitting rules are resolved once per distinct skeleton, to token ranges.
3. The rules are joined back (broadcast where their count allows it) and the values
   are read from the token positions. Steps 1 and 3 are built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.runtime import broadcast_if_small, fresh, stage

_RUN = r"[\p{L}\p{M}\p{Nd} \u00a0]"
_TOKENS = rf"{_RUN}+|[^\p{{L}}\p{{M}}\p{{Nd}} \u00a0]"
#: Signs that stand for classes of runs in a skeleton, and the one before a run that opens with a blank.
_CLASSES = {k: chr(0xE000 + i) for i, k in enumerate("9dAuUmaS")}
_NAMES = {v: k for k, v in _CLASSES.items()}
_LEAD = "\ue00e"
#: Signs that separate wherever they stand outside quotes, if any of them does.
STRONG = frozenset("|¦\n\r\t")
#: Signs that separate only between entries that look like entries.
ODD = frozenset("^~")
QUOTES = frozenset("\"'")
_BLANK = frozenset({" ", "S"})


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))


def _steps() -> list[tuple[str, str]]:
    """Patterns replaced in this order; a replacement stands for the class of a whole run."""
    b, e, s = f"(?<!{_RUN})", f"(?!{_RUN})", r"[  ]"
    return [
        ("[\ue000-\ue00f]", "\ue00f"),
        (f"{b}{s}++{e}", _CLASSES["S"]),
        (f"{b}{s}++", _LEAD),
        (rf"{b}\p{{Nd}}++{s}*+{e}", _CLASSES["9"]),
        (rf"{b}\p{{Nd}}{_RUN}*+", _CLASSES["d"]),
        (rf"{b}\p{{Lu}}{s}*+{e}", _CLASSES["u"]),
        (rf"{b}\p{{Lu}}[\p{{Lu}}\p{{Nd}}]*+{s}*+{e}", _CLASSES["U"]),
        (rf"{b}m\p{{Nd}}++{s}*+{e}", _CLASSES["m"]),
        (rf"{b}\p{{Lu}}{_RUN}*+", _CLASSES["A"]),
        (f"{b}{_RUN}++", _CLASSES["a"]),
    ]


def skeleton(text: Column) -> Column:
    """The text with one sign for each run of ordinary characters, by class: digits only, digit first, capitalised
    word first, capitals with digits, one capital, m with digits, anything else, blanks only; a leading blank is kept."""
    for pattern, sign in _steps():
        text = F.regexp_replace(text, pattern, sign)
    return text


def _classes(skel: str) -> list[str]:
    out, lead = [], ""
    for c in skel:
        if c == _LEAD:
            lead = " "
        else:
            out.append(lead + _NAMES.get(c, c))
            lead = ""
    return out


def _quote_end(t: list[str], at: int, closers: frozenset[str]) -> int | None:
    """Place of the quote that closes the one at ``at``, directly before a separator or the end (blanks aside)."""
    q, i = t[at], at + 1
    while i < len(t):
        if t[i] == q:
            if i + 1 < len(t) and t[i + 1] == q:
                i += 2
                continue
            j = i + 1
            while j < len(t) and t[j] in _BLANK:
                j += 1
            if j == len(t) or t[j] in closers or t[j] == "/":
                return i
        i += 1
    return None


def _code_at(t: list[str], at: int) -> bool:
    """Whether an entry that starts at ``at`` opens with a code: 1=, -1=, (1), 1., A_1 followed by a comma."""
    while at < len(t) and t[at] in _BLANK:
        at += 1
    if at < len(t) and t[at] in QUOTES:
        at += 1
    r = [x.strip() if x not in ("\n", "\r", "\t") else x for x in t[at : at + 5]] + [""] * 5
    if r[0] == "(":
        k = 2 if r[1] == "-" else 1
        return r[k] in ("9", "U", "u") and r[k + 1] == ")"
    k = 1 if r[0] == "-" else 0
    if r[k] == "9" and r[k + 1] in ("=", ".") and not (r[k + 1] == "." and r[k + 2] == "9"):
        return True
    if r[0] in ("U", "u", "A", "a", "m") and r[1] == "=":
        return r[0] in ("U", "u")
    return r[0] in ("U", "u") and r[1] == "_" and r[2] in ("9", "m") and r[3] == ","


def resolve(skel: str) -> list[tuple[int, int, str]] | None:
    """Ranges of tokens (first, past the last) of the values, with the quote around each; None for no list."""
    t = _classes(skel)
    n = len(t)
    closers = STRONG | ODD | frozenset(",;")
    # What quotes hold is closed to separators; a quote opens only where an entry starts.
    # It may only start after a sign that can separate, so openings are told left to right.
    inside = [False] * n
    i, start = 0, True
    while i < n:
        if start and t[i] in QUOTES:
            end = _quote_end(t, i, closers)
            if end is not None:
                for k in range(i, end + 1):
                    inside[k] = True
                i, start = end + 1, False
                continue
        if t[i] not in _BLANK:
            start = t[i] in closers or t[i] == "/"
        i += 1
    depth, deep = 0, [False] * n
    for i in range(n):
        if inside[i]:
            continue
        if t[i] == "(":
            depth += 1
        elif t[i] == ")":
            depth = max(0, depth - 1)
        deep[i] = depth > 0
    if depth:  # unbalanced: brackets protect nothing
        deep = [False] * n
    free = [i for i in range(n) if not inside[i]]

    def cut(at: list[int]) -> list[tuple[int, int]]:
        edges = [-1, *at, n]
        return [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]

    def head(a: int, b: int) -> str:
        return next((x.strip() if x.strip() else x for x in t[a:b] if x not in _BLANK), "")

    strong = [i for i in free if t[i] in STRONG]
    odd = [i for i in free if t[i] in ODD and not deep[i]]
    if odd:
        parts = [(a, b) for a, b in cut(odd) if any(x not in _BLANK for x in t[a:b])]
        if not (len(parts) > 1 and (all(_code_at(t, a) for a, _ in parts) or all(head(a, b) in ("A", '"', "'", "U") for a, b in parts))):
            odd = []
    weak = {s: [i for i in free if t[i] == s] for s in ";,"}
    coded = _code_at(t, 0) or any(_code_at(t, i + 1) for i in (*strong, *odd))
    at = set(strong) | set(odd)
    if coded:
        for s in ";,":
            here = {i for i in weak[s] if _code_at(t, i + 1)}
            if here:  # and the same sign where nothing follows it, or only itself
                here |= {i for i in weak[s] if head(i + 1, n) in ("", s)}
            at |= here
        if not at:
            at = {i for i in free if t[i] == "/" and _code_at(t, i + 1)}
    elif not at:
        semi = [i for i in weak[";"] if not deep[i]]
        comma = [i for i in weak[","] if not deep[i]]
        quoted = any(inside)
        if semi and _likely(t, cut(semi), inside, quoted):
            at = set(semi)
        elif comma:
            tight = [i for i in comma if i + 1 < n and not t[i + 1].startswith(" ") and t[i + 1] != "S" and not (t[i - 1].endswith("9") and t[i + 1] in ("9", "d"))]
            if quoted:  # the quoted labels hold their own commas
                tight = comma
            if tight and _likely(t, cut(tight), inside, quoted):
                at = set(tight)
        if not at:
            slash = [i for i in free if t[i] == "/" and not deep[i]]
            parts = [[x for x in t[a:b] if x not in _BLANK] for a, b in cut(slash)]
            if slash and all(len(p) == 1 and p[0].strip() == "A" for p in parts):
                at = set(slash)
    out = []
    for a, b in cut(sorted(at)):
        while a < b and t[a] in _BLANK:
            a += 1
        while a < b and t[b - 1] in _BLANK:
            b -= 1
        if a == b:
            continue
        if inside[a] and inside[b - 1] and t[a] in QUOTES and t[b - 1] == t[a] and b - a > 1:
            if any(x not in _BLANK for x in t[a + 1 : b - 1]):
                out.append((a + 1, b - 1, t[a]))
        else:
            out.append((a, b, ""))
    return out if len(out) > 1 else None


def _likely(t: list[str], parts: list[tuple[int, int]], inside: list[bool], quoted: bool) -> bool:
    """Whether the parts of an uncoded list all look like labels: quoted, or opening with a capital, figure or sign."""
    heads = []
    for a, b in parts:
        x = [k for k in range(a, b) if t[k] not in _BLANK]
        if x:
            heads.append("q" if inside[x[0]] else t[x[0]].strip())
    return len(heads) > 1 and all(h in ("q", "A", "U", "u", "9", "d", "<", ">", "$", "-", "+") for h in heads)


def split_packed(df: DataFrame, column: str, *, max_broadcast: int = 100_000) -> DataFrame:
    """One row per value of ``column``, with every column of ``df`` and ``pos`` (from 1) and ``item``.

    Fields that hold fewer than two values give no row; nulls and empty texts neither.
    Repeated rows are all kept. Where ``df`` has ``pos`` or ``item`` already, the new
    columns get leading underscores. ``max_broadcast`` bounds the counted rule rows
    that are broadcast; beyond it the rules are joined by a shuffle on the skeleton.
    """
    pos, item, toks, skel, rules = fresh(df, "pos", "item", "toks", "skel", "rules")
    cut = df.where(F.col(column).rlike(r"[|¦\n\r\t^~;,/]")).withColumn(toks, tokens(F.col(column)))
    marked = cut.withColumn(skel, skeleton(F.col(column)))
    rule_type = f"{skel} string, {rules} array<struct<a:int,b:int,q:string>>"
    rules_arrow = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("q", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for s in batch.column(0).to_pylist():
                r = resolve(s)
                if r:
                    keep.append(s)
                    found.append([{"a": a, "b": b, "q": q} for a, b, q in r])
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string()), pa.array(found, rules_arrow)], names=[skel, rules])

    resolved = stage(marked.select(skel).distinct().mapInArrow(run, rule_type), "rules")
    joined = marked.join(broadcast_if_small(resolved, max_broadcast), skel)
    text = lambda r: F.array_join(F.slice(F.col(toks), r["a"] + 1, r["b"] - r["a"]), "")
    trimmed = lambda c: F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    value = lambda r: trimmed(F.when(r["q"] != "", F.replace(text(r), F.concat(r["q"], r["q"]), r["q"])).otherwise(text(r)))
    out = joined.withColumn(rules, F.transform(F.col(rules), value))
    return out.select(*(F.col(c) for c in df.columns), F.posexplode(rules).alias(pos, item)).withColumn(pos, (F.col(pos) + 1).cast("int"))


def split_text(text: str) -> list[str]:
    """The same split for one text in plain Python, as the tests' brute force."""
    import regex

    toks, skel = regex.findall(_TOKENS, text), text
    for pattern, sign in _steps():
        skel = regex.sub(pattern, sign, skel)
    return [
        re.sub(r"^\s+|\s+$", "", "".join(toks[a:b]).replace(q + q, q) if q else "".join(toks[a:b]))
        for a, b, q in resolve(skel) or []
    ]
