"""Matching rows of several dictionaries that share no key.

Attributes are read from a row's variable name and description. Nothing is known of the
instruments beforehand: a word of descriptions is the name of one when the first part of
variable names abbreviates it (its beginning, its consonants, or itself) again and
again; a word one letter off a far more frequent one is a slip. Measure codes are the
second parts of names with delimiters, and cut names without them. Periods are read from
names and descriptions by a table of codes and wordings, which is a parameter.

A cascade of exact joins then gives every row its instrument, from full evidence to
weaker combinations; each pass takes only rows that no earlier one resolved. Rows that
name no instrument at all are joined by their whole name, then by their whole text.
Periods that a row leaves unsaid come from its item number where that decides. Rows match
when instrument and measure agree and nothing said contradicts.

Each rule's precision is measured on rows whose instrument is known in full: of the pairs
of different rows that the rule's join makes between them, the share with the same
instrument, with smoothing. It is the confidence of what the rule resolved. Units and
numbers of codes that differ take a part of it away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.runtime import stage

#: Period codes of variable names and the wordings of descriptions: the default of a parameter.
PERIODS = {
    "bl": ("at baseline", "at study entry"),
    "f1": ("at the first follow-up", "at follow-up one"),
    "py": ("in the past year", "over the previous 12 months"),
    "pm": ("in the past month", "during the last 30 days", "dur. the last 30 days"),
    "pw": ("in the past week", "over the last 7 days"),
    "ev": ("ever", "at any time in life"),
    "ch": ("in childhood", "when the person was a child"),
    "bp": ("before pregnancy", "prior to being pregnant"),
}
#: Rows in which names must abbreviate a word for it to be an instrument, and how much oftener a word is than its slips.
EVIDENCE, SLIP = 2, 4
#: Share of the rows with a word whose names must abbreviate it.
SHARE = 0.5
#: What is left of a confidence when units or numbers of codes differ.
DIFFERS = 0.9
_V = "aeiou"
_WORD = re.compile(r"[^\W\d_]{4,}\.?")
_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+\d*|[A-Z]+\d*|\d+")
_RUN = re.compile(r"[^\W_]+")
_DELIMITED = re.compile(r"[._\- ]")
_ITEM = re.compile(r"\b(?:item|question|no\.?|nr\.?|frage|élément|ítem|pregunta|\w{3,5}) (\d+)\b(?= - |\s*$|:)", re.I)


class Periods:
    """A table of period codes and wordings, and texts read by it."""

    def __init__(self, table: dict[str, tuple[str, ...]]):
        self.table = table
        self.exact = [(k, w, re.compile(rf"\b{re.escape(w)}\b")) for k, ws in table.items() for w in ws]
        # A wording with a slip keeps the beginning or the end of one of its longer words.
        ends = lambda w: {x for y in w.split() if len(y) >= 4 for x in (y[:3], y[-3:])}
        self.slips = [(k, tuple(ends(w)), regex.compile(rf"\b(?:{regex.escape(w)}){{1<=e<=2}}(?![\w])")) for k, ws in table.items() for w in ws if len(w) > 8]
        self.ending = re.compile(rf"^(.*?)({'|'.join(map(re.escape, table)) or '(?!)'})?(\d*)$")

    def read(self, text: str | None) -> tuple[str | None, str]:
        """(the one period of a text, or none where it says none or several; the text in small letters without it)."""
        if not text:
            return None, ""
        s = bare = text.lower()
        found = set()
        for k, w, p in self.exact:
            if w in s and p.search(s):
                found.add(k)
                bare = p.sub(" ", bare)
        if not found:
            found = {k for k, ends, p in self.slips if any(x in s for x in ends) and p.search(s)}
        return (found.pop() if len(found) == 1 else None), bare


def consonants(word: str) -> str:
    return re.sub(f"[{_V}]", "", word)


def abbreviates(part: str, word: str, cons: str) -> bool:
    """Whether a part of a variable name can stand for ``word`` with the consonants ``cons``: itself, its beginning, or the
    beginning of its consonants. A shortened word (with a point) has only the first of them."""
    if len(part) < 4 or not part.isalpha():
        return False
    if word[-1] == ".":
        return word.startswith(part) or (len(part) >= 5 and len(cons) >= 3 and (part.startswith(cons) or cons.startswith(part)))
    return word.startswith(part) or (len(part) >= 5 and cons.startswith(part))


def _capital_parts(name: str, periods: Periods) -> list[str]:
    """Parts of a name by its capitals. The last may be a period with an item number, or a code with one; a leading v keeps its digits."""
    found = [x.lower() for x in _PART.findall(name)]
    out = found[:-1]
    for x in found[-1:]:
        code, period, digits = periods.ending.match(x).groups()
        if len(found) > 1 and period and not code:
            out += [period, digits] if digits else [period]
        elif len(found) > 1 and digits and code:
            out += [code + (period or ""), digits]
        else:
            out.append(x)
    return out


def parse_name(name: str, periods: Periods) -> tuple[str | None, str | None, str | None, str | None]:
    """(first part, measure, period, item) of a name with delimiters or capitals inside; nulls for a name of one run."""
    v = name.strip()
    t = [x.lower() for x in _DELIMITED.split(v) if x] if _DELIMITED.search(v) else _capital_parts(v, periods)
    if len(t) < 2 or (not _DELIMITED.search(v) and not re.search(r"[a-z][A-Z]", v)):
        return None, None, None, None
    if len(t) == 2 and not _DELIMITED.search(v) and t[1].isdigit():
        return None, None, None, None
    return t[0], t[1], next((x for x in t[2:] if x in periods.table), None), next((x for x in t[2:] if x.isdigit()), None)


def cuts(name: str, words: list[str], periods: Periods) -> list[tuple[str, str, str | None, str | None, bool]]:
    """Ways to cut a name without delimiters: (first part, measure, period, item, whether the first part abbreviates a word)."""
    v = re.sub(r"[^a-z0-9]", "", name.strip().lower())
    out = []
    known = [(w, consonants(w.rstrip("."))) for w in words]
    for k in range(3, len(v) - 1):
        part = v[:k]
        coded = re.fullmatch(r"v\d+", part)
        if coded and v[k].isdigit():
            continue
        near = any(abbreviates(part, w, c) for w, c in known)
        if not coded and not near and (k < 6 or not part.isalpha()):
            continue
        m, t, n = periods.ending.match(v[k:]).groups()
        for measure, period in {(m, t), (m + (t or ""), None)}:
            if len(measure) >= 2:
                out.append((part, measure, period, n or None, near))
            if n and measure and len(n) > 0:
                out += [(part, measure + (period or "") + n[:1], None, n[1:] or None, near)] if period is None else []
    return out


def whole_name(name: str, periods: Periods) -> tuple[str, str | None]:
    """(all letters and digits of a name without its period, the period)."""
    t = [x.lower() for x in re.split(r"[^A-Za-z0-9]+", name) if x]
    period = next((x for x in t[1:] if x in periods.table), None)
    return "".join(x for i, x in enumerate(t) if i == 0 or x != period), period


def attributes(refs: DataFrame, key: str, source: str, name: str, description: str, periods: dict[str, tuple[str, ...]] = PERIODS) -> DataFrame:
    """(id, source, part, m, t, n, words, whole, text, facts): what each row says; ``words`` may name an instrument, ``text`` is the description without period and order."""
    table = Periods(periods)
    kind = refs.schema[key].dataType.simpleString()
    more = [F.col(c).cast("string") if c in refs.columns else F.lit(None).cast("string") for c in ("units", "n_codes")]
    base = refs.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(name).alias("name"), F.col(description).alias("text"), F.lower(F.trim(more[0])).alias("units"), more[1].alias("codes")).where("id is not null and source is not null and name is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_type = pa.list_(pa.struct([("part", pa.string()), ("m", pa.string()), ("t", pa.string()), ("n", pa.string()), ("near", pa.bool_())]))
        for batch in batches:
            out: list[tuple] = []
            for name_, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = list(dict.fromkeys(w.lower() for w in _WORD.findall(text or "")))
                part, m, t, n = parse_name(name_, table)
                ways = [] if m else cuts(name_, words, table)
                whole, own = whole_name(name_, table)
                item = _ITEM.search(text or "")
                said, bare = table.read(text)
                plain = " ".join(_RUN.findall(bare))
                out.append((part, m, t, n, said, item[1] if item else None, words, [dict(zip(("part", "m", "t", "n", "near"), w, strict=True)) for w in ways], whole, own, plain))
            a = list(zip(*out, strict=True)) or [[]] * 11
            strings = [pa.array(a[k], pa.string()) for k in (0, 1, 2, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *strings, pa.array(a[6], pa.list_(pa.string())), pa.array(a[7], cut_type), pa.array(a[8], pa.string()), pa.array(a[9], pa.string()), pa.array(a[10], pa.string()), batch.column(4), batch.column(5)], names=["id", "source", "part", "m", "t", "n", "said", "item", "words", "cuts", "whole", "own", "text", "units", "codes"])

    schema = f"id {kind}, source string, part string, m string, t string, n string, said string, item string, words array<string>, cuts array<struct<part:string,m:string,t:string,n:string,near:boolean>>, whole string, own string, text string, units string, codes string"
    read = stage(base.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "read")
    codes = read.where("m rlike '^[a-z]{2,}[0-9]?$'").select("m").distinct()
    glued = read.where("m is null").select("row", F.explode("cuts").alias("c")).select("row", "c.*")
    glued = _joined(glued, codes, "m", "left_semi")
    # A first part that abbreviates no word of the row must be the name of an instrument itself, or a coded one.
    other = _joined(glued.where("not near and part not rlike '^v[0-9]+$'"), lexicon(read).select(F.col("inst").alias("part")), "part", "left_semi")
    sure = glued.where("near or part rlike '^v[0-9]+$'").unionByName(other.select(*glued.columns))
    best = sure.groupBy("row").agg(F.max(F.struct("near", F.length("m").alias("l"), F.length("part").alias("k"), "part", "m", "t", "n")).alias("b"))
    read = _joined(read, best, "row", "left")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"b.{c}")).alias(c)
    return stage(read.select("row", "id", "source", pick("part"), pick("m"), F.coalesce("t", "b.t", "said").alias("t"), F.coalesce("n", "b.n", "item").alias("n"), "words", "whole", F.coalesce("own", "said").alias("own"), "text", "units", "codes"), "attributes")


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` by a merge of both, so no side goes through the driver. Spark weighs a table by its
    packed file, before words and cuts are exploded, and would broadcast sides hundreds of times that size."""
    return left.join(right.hint("merge"), on, how)


def _consonants(c: Column) -> Column:
    return F.regexp_replace(c, f"[{_V}]", "")


def _cut_one(word: Column) -> Column:
    """A word and all it is with one letter cut: words one slip apart (a letter lost, doubled or swapped) share one."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word))))))


def _abbreviates(part: Column, word: Column) -> Column:
    return (F.length(part) >= 4) & part.rlike("^[a-z]+$") & (F.startswith(word, part) | ((F.length(part) >= 5) & F.startswith(_consonants(word), part)))


def _unique(found: DataFrame) -> DataFrame:
    """(row, inst) of rows with exactly one candidate."""
    return found.groupBy("row").agg(F.min("inst").alias("inst"), F.max("inst").alias("top")).where("inst = top").drop("top")


def lexicon(rows: DataFrame) -> DataFrame:
    """(inst, cons): words of descriptions that the first parts of names abbreviate in ``EVIDENCE`` rows or more, without slips and shortened forms."""
    word = F.col("word")
    each = rows.where("part is not null").select("part", F.explode("words").alias("word")).where(~word.endswith(".") & (F.length("word") >= 6))
    told = each.where(F.col("part").rlike("^[a-z]{4,}$")).groupBy("word").agg(F.count(F.when(_abbreviates(F.col("part"), word), 1)).alias("c"), F.count("*").alias("k"))
    often = stage(told.where((F.col("c") >= EVIDENCE) & (F.col("c") >= SHARE * F.col("k"))).select("word", "c"), "often")
    cut = often.select("word", "c", F.explode(_cut_one(word)).alias("cut"))
    other = cut.select(F.col("word").alias("w2"), F.col("c").alias("c2"), "cut")
    slips = _joined(cut, other, "cut").where("word <> w2 and abs(length(word) - length(w2)) <= 1").where(F.col("c2") >= SLIP * F.col("c")).select("word").distinct()
    return stage(_joined(often, slips, "word", "left_anti").select(F.col("word").alias("inst"), _consonants(word).alias("cons")), "lexicon")


def instruments(rows: DataFrame) -> DataFrame:
    """``rows`` with ``inst`` and ``rule``: the cascade."""
    names = lexicon(rows)
    readable = rows.where("m is not null")
    words = readable.select("row", "part", "m", "t", "n", F.explode("words").alias("w"))
    words = words.where(F.length(F.regexp_replace("w", r"\.$", "")) >= 5)
    fit = F.coalesce(~F.col("part").rlike("^[a-z]{4,5}$"), F.lit(True)) | F.startswith(F.col("inst"), F.col("part")) | F.startswith(F.col("cons"), F.col("part"))

    def settle(found: DataFrame, left: DataFrame, rule: str) -> tuple[DataFrame, DataFrame]:
        got = stage(_unique(found), "got")
        return _joined(left, got, "row").withColumn("rule", F.lit(rule)), stage(_joined(left, got.select("row"), "row", "left_anti"), "left")

    exact = _joined(words, names, F.col("w") == F.col("inst"))
    # Words that name several instruments leave it to the first part; without them, the first part alone may be one.
    full = exact.where(fit).select("row", "inst")
    own = _joined(readable, names, F.col("part") == F.col("inst")).select("row", "inst")
    done, left = settle(full.unionByName(own).distinct(), readable, "full")
    done = stage(done, "full")
    seen = stage(_joined(done.select("inst", "m", "t", "n").distinct(), names, "inst"), "seen")
    prefixes = F.explode(F.transform(F.sequence(F.lit(5), F.greatest(F.length("inst") - 1, F.lit(5))), lambda k: F.substring("inst", 1, k)))
    short = lambda x: x.select("row", "part", "m", "t", "n", F.explode("words").alias("w")).where(F.col("w").endswith(".")).withColumn("six", F.regexp_replace("w", r"\.$", ""))
    cut_words = lambda x: x.select("row", "part", F.explode("words").alias("w")).withColumn("w", F.regexp_replace("w", r"\.$", "")).where(F.length("w") >= 5).withColumn("cut", F.explode(_cut_one(F.col("w"))))
    by_prefix = seen.withColumn("six", prefixes)
    passes = [
        # a shortened name with measure and period, with measure and item, with the measure, alone
        ("short_all", lambda x: _joined(short(x).where("t is not null"), by_prefix.drop("n"), ["six", "m", "t"])),
        ("short_item", lambda x: _joined(short(x).where("n is not null"), by_prefix.drop("t"), ["six", "m", "n"])),
        ("short_measure", lambda x: _joined(short(x).select("row", "part", "six", "m"), by_prefix.select("six", "m", "inst", "cons").distinct(), ["six", "m"])),
        ("short", lambda x: _joined(short(x).select("row", "part", "six"), names.withColumn("six", prefixes), "six")),
        # a slip in the name, full or shortened: words one cut apart
        ("slip", lambda x: _joined(cut_words(x), names.withColumn("cut", F.explode(_cut_one(F.col("inst")))), "cut").where("abs(length(w) - length(inst)) <= 1")),
        ("slip_short", lambda x: _joined(cut_words(x), names.withColumn("six", F.substring("inst", 1, 6)).withColumn("cut", F.explode(_cut_one(F.col("six")))), "cut").where("abs(length(w) - 6) <= 1")),
        # the first part of the variable name with measure and period
        ("consonants", lambda x: _joined(x.where("length(part) = 5"), seen.withColumnRenamed("cons", "part").where("t is not null").select("part", "m", "t", "inst").distinct(), ["part", "m", "t"]).withColumn("cons", F.col("part"))),
    ]
    # A row goes by the first pass that leaves it one candidate. Each pass is a job, so the driver holds the tasks and
    # shuffles of one at a time.
    single = None
    for k, (_, join) in enumerate(passes):
        one = stage(_unique(join(left).where(fit).select("row", "inst")).withColumn("pass", F.lit(k)), "pass")
        single = one if single is None else single.unionByName(one)
    first = single.groupBy("row").agg(F.min(F.struct("pass", "inst")).alias("f"))
    rules = F.array(*(F.lit(rule) for rule, _ in passes))
    got = stage(first.select("row", "f.inst", F.element_at(rules, F.col("f.pass") + 1).alias("rule")), "got")
    done = done.unionByName(_joined(left, got, "row").select(*done.columns))
    left = _joined(left, got.select("row"), "row", "left_anti")
    # Rows that name no instrument: the same whole name in several sources, then the same text as one of these.
    rest = left.unionByName(rows.where("m is null")).drop("inst", "rule").withColumn("t", F.coalesce("t", "own"))
    spread = stage(rest.groupBy("whole").agg(F.count_distinct("source").alias("k")).where("k > 1").select("whole"), "spread")
    named = stage(_joined(rest, spread, "whole").withColumn("inst", F.concat(F.lit("="), "whole")).withColumn("rule", F.lit("as_written")).withColumn("m", F.lit("")), "as_written")
    alone = _joined(rest, spread, "whole", "left_anti").where("text <> ''")
    texts = named.groupBy("text").agg(F.min("inst").alias("inst"), F.max("inst").alias("top")).where("inst = top and text <> ''").drop("top")
    told = _joined(alone, texts, "text", "left").withColumn("inst", F.coalesce("inst", F.concat(F.lit("~"), "text"))).withColumn("rule", F.lit("same_text")).withColumn("m", F.lit(""))
    cols = ["row", "id", "source", "inst", "m", "t", "n", "part", "whole", "text", "units", "codes", "rule"]
    return stage(done.select(*cols).unionByName(named.select(*cols)).unionByName(told.select(*cols)), "named")


def precisions(rows: DataFrame) -> dict[str, float]:
    """Smoothed precision of each rule, from rows whose instrument is known in full: of the pairs of different rows
    that the rule's attributes join, the share that has the same instrument (and measure, for whole names and texts)."""
    full = rows.where("rule = 'full'").select("inst", F.substring("inst", 1, 6).alias("six"), _consonants(F.col("inst")).alias("cons"), "m", "t", "n", "whole", F.nullif("text", F.lit("")).alias("text"))
    keys = {"full": ["inst"], "short_all": ["six", "m", "t"], "short_item": ["six", "m", "n"], "short_measure": ["six", "m"], "short": ["six"], "consonants": ["cons", "m", "t"], "slip": ["cut"], "slip_short": ["cut6"], "as_written": ["whole"], "same_text": ["text"]}
    sides = {"slip": full.withColumn("cut", F.explode(_cut_one(F.col("inst")))), "slip_short": full.withColumn("cut6", F.explode(_cut_one(F.col("six"))))}
    parts = None
    for rule, ks in keys.items():
        # A class of rows that can't be told apart: the same instrument, for whole names the same measure too.
        own = ["inst", "m"] if rule in ("as_written", "same_text") else ["inst"]
        per = sides.get(rule, full).where(" and ".join(f"{k} is not null" for k in ks)).groupBy(*dict.fromkeys([*ks, *own])).agg(F.count("*").cast("double").alias("c"))
        both = per.groupBy(*ks).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum("c").alias("s"))
        one = both.agg(F.lit(rule).alias("rule"), F.sum("same").alias("same"), F.sum(F.col("s") * (F.col("s") - 1)).alias("all"))
        parts = one if parts is None else parts.unionByName(one)
    return {r["rule"]: ((r["same"] or 0.0) + 1) / ((r["all"] or 0.0) + 2) for r in parts.collect()}


def match(refs: DataFrame, *, key: str = "ref_id", source: str = "dictionary_name", name: str = "variable_name", description: str = "description", periods: dict[str, tuple[str, ...]] = PERIODS) -> DataFrame:
    """(a, b, confidence), a < b: rows of different sources that describe the same variable.

    Same instrument and measure; periods and item numbers agree or are left unsaid. Rows
    repeated within a source each form their own pairs. Rows without a source, id or
    variable name match nothing.
    """
    rows = instruments(attributes(refs, key, source, name, description, periods))
    trust = precisions(rows)
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in trust.items() for x in kv)), F.col("rule"))
    rows = rows.select("id", "source", "inst", "m", "t", "n", "units", "codes", weight.alias("w"))
    # An item number stands for one period within an instrument and measure.
    by_item = rows.where("t is not null and n is not null").groupBy("inst", "m", "n").agg(F.min("t").alias("t2"), F.max("t").alias("top")).where("t2 = top").drop("top")
    timed = _joined(rows.where("t is null and n is not null"), by_item, ["inst", "m", "n"], "left").withColumn("t", F.col("t2")).withColumn("w", F.when(F.col("t2").isNull(), F.col("w")).otherwise(F.col("w") * 0.99)).drop("t2")
    rows = stage(rows.where("t is not null or n is null").unionByName(timed), "timed")
    known, open_ = rows.where("t is not null"), rows.where("t is null")
    # Items that the rows of a period show, to hold against rows that say an item but no period.
    items = known.where("n is not null").groupBy("inst", "m", "t").agg(F.min("n").alias("n"))

    def pairs(left: DataFrame, right: DataFrame, on: list[str], cond: str | None, mirror: bool) -> DataFrame:
        """Rows of different sources that agree in ``on``; sources are paired first, so rows of one source never meet."""
        ls, rs = left.select(*on, "source").distinct(), right.select(*on, F.col("source").alias("source_b")).distinct()
        sides = _joined(ls, rs, on).where("source < source_b" if mirror else "source <> source_b")
        a = left.select(*on, "source", F.col("id").alias("a"), F.col("n").alias("na"), F.col("w").alias("wa"), F.col("units").alias("ua"), F.col("codes").alias("ca"))
        b = right.select(*on, F.col("source").alias("source_b"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("w").alias("wb"), F.col("units").alias("ub"), F.col("codes").alias("cb"))
        out = _joined(_joined(sides, a, [*on, "source"]), b, [*on, "source_b"])
        out = out.where(cond) if cond else out
        off = lambda x, y: F.when(F.coalesce(F.col(x) != F.col(y), F.lit(False)), DIFFERS).otherwise(1.0)
        return stage(out.select("a", "b", (F.least("wa", "wb") * off("ua", "ub") * off("ca", "cb")).alias("w")), "pairs")

    same = pairs(known, known, ["inst", "m", "t"], None, True)
    labelled = _joined(known.drop("n"), items, ["inst", "m", "t"], "left").select("id", "source", "inst", "m", "n", "w", "units", "codes")
    unsaid = "na is null or nb is null or na = nb"
    # A period left unsaid: the fewer periods the measure shows, the surer the match.
    choices = F.count_distinct("t").alias("ts")
    many = known.groupBy("inst", "m").agg(choices)
    loose = _joined(open_, many, ["inst", "m"], "left").withColumn("w", F.col("w") / F.coalesce("ts", F.lit(1))).drop("ts", "t")
    half = pairs(loose, labelled, ["inst", "m"], unsaid, False)
    none = pairs(loose, loose, ["inst", "m"], unsaid, True)
    found = same.unionByName(half).unionByName(none)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("w", 4).alias("confidence"))
