"""Mixing sources to target shares of tokens, by entropy balancing.

Every document has a rate (expected copies) between 0 and ``max_repeats``: the largest
rate, tilted by exp(lambda * tokens) of its source. The lambdas solve the convex dual
of "stay close to the largest rates, but give each source its tokens": Newton steps
whose sums are taken over all documents. The total is the largest that every source
can serve. Rates become whole copies by systematic rounding of their running sum in
order of size; what a source then lacks or has too much is mended by single documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.runtime import stage

STEPS = 60
#: Documents that may be added to or dropped from a source of a mix after rounding.
MENDS = 6
#: Documents of a block of the running sums, and blocks that each band of sizes has at least.
BLOCK_ROWS, LEAST_BLOCKS = 20_000, 64


def balance(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, goal, lam, parts): the tilt of each source in each mix.

    Sources don't share documents, so the dual falls into one equation for each source
    of each mix; the Newton steps of all of them are taken together.

    ``sizes`` is (source, n, docs): how many documents of a source have n tokens. Newton
    sums over it equal those over the documents, one row each.
    """
    spark = sizes.sparkSession
    have = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("docs")).cast("double").alias("tokens"), F.sum("docs").alias("docs"))
    t = targets.where("target_share is not null and mix_name is not null").join(have, "source", "left").fillna(0.0, ["tokens"]).fillna(0, ["docs"])
    # The largest total: no source has to give more than all its documents max_repeats times.
    # A source without documents can't give anything: the others share among themselves, and the report shows it.
    limit = F.min(F.when((F.col("target_share") > 0) & (F.col("tokens") > 0), F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).over(Window.partitionBy("mix_name"))
    rows = t.withColumn("goal", F.coalesce(limit, F.lit(0.0)) * F.col("target_share")).collect()  # mixes x sources
    state = {(r["mix_name"], r["source"]): {**r.asDict(), "lam": 0.0, "low": None, "high": 0.0, "fixed": r["goal"] <= 0 or r["tokens"] <= 0 or r["goal"] >= r["tokens"] * r["max_repeats"] * (1 - 1e-9)} for r in rows}
    for _ in range(STEPS):
        open_ = [s for s in state.values() if not s["fixed"]]
        if not open_:
            break
        lams = spark.createDataFrame([(s["mix_name"], s["source"], float(s["lam"]), float(s["max_repeats"])) for s in open_], "mix_name string, source string, lam double, cap double")
        rate = F.col("cap") * F.exp(F.col("lam") * F.col("n"))
        sums = sizes.join(F.broadcast(lams), "source").groupBy("mix_name", "source").agg(F.sum(rate * F.col("n") * F.col("docs")).alias("value"), F.sum(rate * F.col("n") * F.col("n") * F.col("docs")).alias("slope"))
        for r in sums.collect():
            s = state[r["mix_name"], r["source"]]
            gap = r["value"] - s["goal"]
            if abs(gap) <= 1e-9 * s["goal"]:
                s["fixed"] = True
                continue
            if gap > 0:
                s["high"] = s["lam"]
            else:
                s["low"] = s["lam"]
            # Newton on the log of the sum is steadier for a far tilt; the bracket keeps it safe.
            step = s["lam"] - math.log(r["value"] / s["goal"]) * r["value"] / max(r["slope"], 1e-300) if r["value"] > 0 else s["lam"] / 2
            low = s["low"] if s["low"] is not None else 4 * min(s["lam"], -1e-9) - 1.0
            s["lam"] = step if low < step < s["high"] else (low + s["high"]) / 2
    made = [(s["mix_name"], s["source"], float(s["target_share"]), int(s["max_repeats"]), float(s["goal"]), float(s["lam"]) if s["goal"] > 0 and s["tokens"] > 0 else None, max(LEAST_BLOCKS, -(-int(s["docs"]) // BLOCK_ROWS))) for s in state.values()]
    return spark.createDataFrame(made, "mix_name string, source string, target_share double, max_repeats int, goal double, lam double, parts long")


def mix(documents: DataFrame, targets: DataFrame, *, key: str = "doc_id", tokens: str = "n") -> DataFrame:
    """(mix_name, source, id, n, copies): documents of each mix with how often they are used, at least once.

    ``documents`` has ``source`` and token counts; those without tokens or source take no
    part. A source that a mix doesn't name, or gives no share, has none of its rows.
    An empty table, or targets that can't be met at all, give no rows.
    """
    docs = documents.select(F.col(key).alias("id"), "source", F.col(tokens).cast("long").alias("n")).where("n > 0 and source is not null")
    docs = stage(docs.withColumn("uid", F.monotonically_increasing_id()), "sized")  # repeated ids stay apart
    sizes = stage(docs.groupBy("source", "n").agg(F.count("*").alias("docs")), "sizes")
    tilt = stage(balance(sizes, targets).where("lam is not null"), "tilt")
    rated = docs.join(F.broadcast(tilt), "source").withColumn("rate", F.least(F.col("max_repeats") * F.exp(F.col("lam") * F.col("n")), F.col("max_repeats").cast("double")))
    # The running sum has two levels, so that no task holds a source: blocks of about one
    # size and hash first, then rows inside each block.
    rated = rated.withColumn("h", F.xxhash64("uid", "mix_name")).withColumn("block", F.floor(F.log2(F.col("n")) * 8) * F.col("parts") + F.pmod(F.col("h"), F.col("parts")))
    rated = stage(rated.select("mix_name", "source", "id", "uid", "n", "max_repeats", "rate", "h", "block"), "rated")
    inside = Window.partitionBy("mix_name", "source", "block").orderBy("h", "uid").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("mix_name", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = rated.groupBy("mix_name", "source", "block").agg(F.sum("rate").alias("s"))
    base = base.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0.0))).drop("s")
    run = rated.join(base, ["mix_name", "source", "block"]).withColumn("run", F.col("base") + F.sum("rate").over(inside))
    copies = F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("rate") + 0.5)
    rounded = run.withColumn("copies", F.greatest(F.lit(0), F.least(copies, F.col("max_repeats").cast("long"))).cast("int"))
    rounded = stage(rounded.select("mix_name", "source", "id", "uid", "n", "max_repeats", "copies"), "rounded")
    return _mend(rounded, tilt).where("copies > 0").select("mix_name", "source", "id", "n", "copies")


def _mend(rounded: DataFrame, tilt: DataFrame) -> DataFrame:
    """Add or drop one copy for each source of each mix, of the size nearest to its gap, a few times over."""
    spark = rounded.sparkSession
    gaps = {(r["mix_name"], r["source"]): r["gap"] for r in tilt.join(rounded.groupBy("mix_name", "source").agg(F.sum(F.col("n") * F.col("copies")).alias("got")), ["mix_name", "source"], "left").select("mix_name", "source", (F.col("goal") - F.coalesce("got", F.lit(0))).alias("gap")).collect()}
    moved: dict[tuple[str, str, int], int] = {}
    out = rounded
    for _ in range(MENDS):
        gap = spark.createDataFrame([(m, s, float(g)) for (m, s), g in gaps.items() if abs(g) >= 1] or [("", "", 0.0)], "mix_name string, source string, gap double")
        off = F.abs(F.abs("gap") - F.col("n"))
        fits = out.join(F.broadcast(gap), ["mix_name", "source"]).where("(gap > 0 and copies < max_repeats) or (gap < 0 and copies > 0)").where(off < F.abs("gap"))
        best = fits.groupBy("mix_name", "source").agg(F.min(F.struct(off.alias("off"), "uid", "n", F.signum("gap").cast("int").alias("step"))).alias("x")).select("mix_name", "source", "x.*").collect()
        if not best:
            break
        for r in best:
            where = (r["mix_name"], r["source"], r["uid"])
            moved[where] = moved.get(where, 0) + r["step"]
            gaps[where[:2]] -= r["step"] * r["n"]
        moves = spark.createDataFrame([(*k, v) for k, v in moved.items()], "mix_name string, source string, uid long, step int")
        out = rounded.join(F.broadcast(moves), ["mix_name", "source", "uid"], "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step")
    return out


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, reached_share, tokens, documents, most_copies), sources without rows too."""
    used = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    out = targets.select("mix_name", "source", "target_share").join(used, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_copies"])
    return out.withColumn("reached_share", F.round(F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), 6)).select("mix_name", "source", "target_share", "reached_share", "tokens", "documents", "most_copies")
