"""Hash-prefix forest over vectors: nearest neighbours, links and pivot clusters.

A tree gives every vector a long hash string and keeps the vectors sorted by it. The
trees are used on two levels. Each of ``routes`` trees is sorted across the cluster
and cut into ranges that fit a task, which is the top of the descent. Inside a range,
``trees`` further trees of its own strings are sorted arrays. A query descends to its
longest match in each of them and then ascends in all of them together, one prefix
length after the other, until the prefixes hold ``candidates`` vectors between them.
Queries that share a prefix are compared with it by one matrix product. Where more
than a share ``CROWD`` of what a query met is as near as ``floor``, the crowd may go
on outside its prefixes, so it ascends further, up to its whole range. So a vector
travels ``routes`` times, not once for each tree. A table that fits one range needs no
routes: its one range is given to several tasks, each answering some of the queries.
The more ranges a routing tree is cut into, the rarer both vectors of a pair lie in one
of them. So ``top_k`` takes more routes for larger tables (``routes_for``), ``AT_ONCE``
of them in a pass.

Hash signs: random rotations of the leading principal axes, cut at their medians.
Axes and medians are fitted on a bounded sample (``SAMPLE_ROWS``); every vector is
indexed. Vectors travel as 16-bit parts, which moves a cosine by about 0.00001.
``exact_top_k`` is the way without an index, block by block.

Exact copies (equal up to length) are indexed once, by their smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.graph import connected_components
from fieldloom.operators.groups import centroids, representatives
from fieldloom.runtime import broadcast_if_small, stage, unstage

#: Vectors that axes and medians are fitted on.
SAMPLE_ROWS = 20_000
BITS = 58
#: Share of near vectors among the candidates of a query from which it ascends further, and by how much.
CROWD = 0.125
ASCENT = 4
#: Tasks that one range is given to, and the rows it holds for each.
COPIES = 4
COPY_ROWS = 5_000
#: Share of the pairs right at the floor that may lie in different ranges of every routing tree, and the most trees there are keys for.
MISSED = 0.03
MOST_ROUTES = 32
#: Routing trees that vectors are shuffled for in one pass.
AT_ONCE = 4
#: Rows of a block of the exact way.
BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class Forest:
    routes: int = 3
    trees: int = 4
    candidates: int = 2048
    leaf: int = 1024
    axes: int = 32
    range_rows: int = 50_000
    seed: int = 7


@dataclass
class Index:
    reps: DataFrame  # id, code, keys: one row for each class of copies
    copies: DataFrame  # id, rep: members of the classes of two or more
    rows: int
    dim: int
    axes: np.ndarray
    forest: Forest


def _clean(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the rows that take part: full vectors of ``dim`` finite parts, not all zero."""
    lengths = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()])
    if dim is None:
        found = lengths[lengths > 0]
        dim = int(np.bincount(found).argmax()) if len(found) else 0
    places = np.nonzero(lengths == dim)[0] if dim else np.zeros(0, int)
    if not len(places):
        return places, np.zeros((0, dim or 1))
    x = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return places[good], x[good] / norm[good, None]


def _directions(axes: np.ndarray, count: int, seed: int) -> np.ndarray:
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < count:
        parts.append(axes @ np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0])
    return np.hstack(parts)[:, :count].astype(np.float32)


def _keys(x: np.ndarray, directions: np.ndarray, cut: np.ndarray) -> np.ndarray:
    signs = x.astype(np.float32) @ directions > cut
    keys = np.zeros(len(x), np.int64)
    for i in range(BITS):
        keys = (keys << 1) | signs[:, i]
    return keys


def quantize(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit * (32767 / np.maximum(np.abs(unit).max(axis=1, keepdims=True), 1e-12))).astype(np.int16)


def dequantize(codes: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(codes.to_pylist()), np.int16).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def routes_for(rows: int, floor: float, forest: Forest) -> int:
    """Routing trees in which a pair of cosine ``floor`` shares a range at least once, but for a share ``MISSED`` of such pairs.

    Two vectors agree in one sign with probability 1 - angle / pi, and in a range when they
    agree in all signs that lead to it.
    """
    if rows <= forest.range_rows:
        return forest.routes
    together = (1 - np.arccos(np.clip(floor, 0.0, 0.999)) / np.pi) ** np.log2(rows / forest.range_rows)
    needed = np.ceil(np.log(MISSED) / np.log1p(-together)) if together < 1 else 1
    return int(max(forest.routes, min(MOST_ROUTES, needed)))


def build(vectors: DataFrame, forest: Forest, key: str = "vec_id", embedding: str = "embedding", floor: float | None = None) -> Index | None:
    """The index of all vectors that take part; None where there are none. With ``floor``, its routes follow the rows.

    Left out: null ids and vectors, all zeros, vectors with null or non-finite parts or
    of another length than most. A repeated id keeps all its rows.
    """
    source = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    rows = source.count()
    if not rows:
        return None
    if floor is not None:
        forest = replace(forest, routes=routes_for(rows, floor, forest))
    # A share of the hash range, so that no task gathers candidates of all others.
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < F.lit(max(1, int((1 << 32) * min(1.0, SAMPLE_ROWS / rows))))
    sample = source.where(share if rows > SAMPLE_ROWS else F.lit(True)).select(F.col("vec").cast("array<float>").alias("vec")).toArrow().column("vec").combine_chunks()
    _, x = _clean(sample)
    if not len(x):
        return None
    dim = x.shape[1]
    values, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(dim))
    axes = axes[:, np.argsort(-values)][:, : min(forest.axes, dim)]
    routes = [_directions(axes, BITS, forest.seed + r) for r in range(forest.routes)]
    cuts = [np.median(x @ d, axis=0) for d in routes]
    mix = np.random.default_rng(11).integers(1, 2**62, size=(dim, 2)) | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, unit = _clean(batch.column(1), dim)
            if not len(places):
                continue
            keys = np.stack([_keys(unit, d, c) | (r << BITS) for r, (d, c) in enumerate(zip(routes, cuts, strict=True))], axis=1)
            with np.errstate(over="ignore"):
                same = np.rint(unit * 8192).astype(np.int64) @ mix
            codes = quantize(unit)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(places)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel()),
                    pa.array(same[:, 0]),
                    pa.array(same[:, 1]),
                ],
                names=["id", "code", "keys", "h1", "h2"],
            )

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
    indexed = stage(source.mapInArrow(run, schema), "index")
    classes = indexed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = stage(indexed.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "rep"), "copies")
    reps = indexed.join(broadcast_if_small(copies.where("id <> rep").select("id")), "id", "left_anti").drop("h1", "h2")
    return Index(reps, copies, indexed.count(), dim, axes, forest)


def leaves(keys: np.ndarray, leaf: int, top: int = BITS - 1) -> Iterator[tuple[int, int]]:
    """Ranges of sorted ``keys``: the longest prefixes that at most ``leaf`` vectors share, or more where they share the whole string."""
    stack = [(0, len(keys), top)]
    while stack:
        a, b, bit = stack.pop()
        if b - a <= leaf or bit < 0:
            if b - a > 1:
                yield a, b
        else:
            m = a + int(np.searchsorted((keys[a:b] >> bit) & 1, 1))
            stack += [(m, b, bit - 1), (a, m, bit - 1)]


def _tree(x: np.ndarray, axes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One tree over a range: its sorted strings and the places in that order (ties by place, so by id)."""
    p = x @ _directions(axes, BITS, seed)
    cut = np.median(p[:: max(1, len(p) // 4096)], axis=0)
    keys = np.zeros(len(x), np.int64)
    for i in range(BITS):
        keys = (keys << 1) | (p[:, i] > cut[i])
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def _local(x: np.ndarray, axes: np.ndarray, tree: int, seed: int, leaf: int) -> Iterator[np.ndarray]:
    """Members of each leaf of one tree over a range."""
    if len(x) <= leaf:
        if tree == 0 and len(x) > 1:
            yield np.arange(len(x))
        return
    keys, order = _tree(x, axes, seed * 1000 + tree)
    for a, b in leaves(keys, leaf):
        yield order[a:b]


def ascend(trees: list[np.ndarray], asked: list[np.ndarray], wanted: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(depth, from, to): for each query the deepest prefix length at which all trees together hold ``wanted`` vectors
    (0, so everything, where none does), and the places of that prefix in each sorted array.

    ``trees`` are sorted strings, ``asked`` the queries' strings in each.
    """

    def spans(depth: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        lo, hi = [], []
        shift = BITS - depth
        for keys, q in zip(trees, asked, strict=True):
            first = (q >> shift) << shift
            lo.append(np.searchsorted(keys, first, "left"))
            hi.append(np.searchsorted(keys, first + (np.int64(1) << shift), "left"))
        return lo, hi

    low, high = np.zeros(len(asked[0]), np.int64), np.full(len(asked[0]), BITS, np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        lo, hi = spans(middle)
        enough = sum(h - l for l, h in zip(lo, hi, strict=True)) >= wanted
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    return low, *spans(low)


def _best(s: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest values of each row at ``floor`` or more; equal ones by column."""
    near = s >= floor
    crowded = np.nonzero(near.sum(axis=1) > k)[0]
    if len(crowded):
        c = s[crowded]
        if k < c.shape[1] - 1:  # all that reach the k-th value, so ties stay in
            c = np.where(c >= np.partition(c, -k, axis=1)[:, -k :-k + 1 if k > 1 else None], c, -3)
        near[crowded] = c >= floor
        over = crowded[near[crowded].sum(axis=1) > k]
        if len(over):
            first = np.argsort(np.where(near[over], -s[over], 9), axis=1, kind="stable")[:, :k]
            near[over] = False
            near[over[:, None], first] = True
    return np.nonzero(near)


def nearest(x: np.ndarray, queries: np.ndarray, axes: np.ndarray, k: int, floor: float, forest: Forest, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cos) as places of ``x``, which is in id order: the k best of what each query meets in a range."""
    none = np.zeros(0, np.int64)
    if len(x) < 2 or not len(queries):
        return none, none, np.zeros(0, np.float32)
    small = len(x) * forest.trees <= forest.candidates
    trees = [_tree(x, axes, seed * 1000 + t) for t in range(1 if small else forest.trees)]
    back = []
    for _, order in trees:
        at = np.empty(len(x), np.int64)
        at[order] = np.arange(len(x))
        back.append(at)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo, wanted = queries, forest.candidates
    while len(todo):
        depth, lo, hi = ascend([t for t, _ in trees], [t[b[todo]] for (t, _), b in zip(trees, back, strict=True)], wanted)
        near, met = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        for t, (_, order) in enumerate(trees):
            # At the root all trees hold the same.
            mine = np.nonzero(depth > 0)[0] if t else np.arange(len(todo))
            if not len(mine):
                continue
            span = lo[t][mine] * (len(x) + 1) + hi[t][mine]
            by = np.argsort(span, kind="stable")
            cuts = np.nonzero(np.diff(span[by]))[0] + 1
            for group in np.split(mine[by], cuts):
                m = np.sort(order[lo[t][group[0]] : hi[t][group[0]]])
                step = max(1, (1 << 24) // len(m))
                for g in range(0, len(group), step):
                    part = group[g : g + step]
                    s = x[todo[part]] @ x[m].T
                    own = np.searchsorted(m, todo[part])
                    s[np.arange(len(part)), own] = -2
                    near[part] += (s >= floor).sum(axis=1)
                    met[part] += len(m)
                    if floor > -1:
                        hit = np.nonzero(s.max(axis=1) >= floor)[0]
                        if not len(hit):
                            continue
                        part, s = part[hit], s[hit]
                    a, b = _best(s, min(k, len(m) - 1), max(floor, -1.5))
                    out.append((todo[part[a]], m[b], s[a, b]))
        on = (depth > 0) & (near > CROWD * met) & (floor > -1)
        todo, wanted = todo[on], wanted * ASCENT
    if not out:
        return none, none, np.zeros(0, np.float32)
    q, n, c = (np.concatenate(z) for z in zip(*out, strict=True))
    _, first = np.unique(q * len(x) + n, return_index=True)
    q, n, c = q[first], n[first], c[first]
    by = np.lexsort((n, -c, q))
    q, n, c = q[by], n[by], c[by]
    start = np.concatenate([[0], np.nonzero(np.diff(q))[0] + 1])
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
    return q[rank < k], n[rank < k], c[rank < k]


def ranges(rows: int, forest: Forest) -> int:
    """Number of ranges. It follows from the rows alone: how far the forest looks must not depend on the session."""
    return 1 if rows <= forest.range_rows else -(-rows * forest.routes // forest.range_rows)


def _ranges(index: Index, run, schema: str, extra: tuple[str, ...] = (), first: int = 0, count: int | None = None) -> DataFrame:
    """``run(route, ids, x, axes, answers, more)`` on tasks that each hold one range of one or more routing trees.

    Ties of the string are cut by id. Rows come in id order; ``answers`` says which of
    them a task answers for, ``more`` holds the ``extra`` columns. With ``count``, only so
    many routing trees from ``first`` on.
    """
    f = index.forest if count is None else replace(index.forest, routes=count)
    n = ranges(index.rows, f)
    copies = max(1, min(COPIES, index.rows // COPY_ROWS)) if n == 1 else 1
    if n == 1:
        each = index.reps.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("key"), "id", "code", *extra)
        ranged = each.repartitionByRange(copies, "key")
    else:
        keys = F.col("keys") if count is None else F.slice("keys", first + 1, count)
        ranged = index.reps.select(F.explode(keys).alias("key"), "id", "code", *extra).repartitionByRange(n, "key", "id")
    dim, axes = index.dim, index.axes.astype(np.float32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        key, ids = table.column("key").to_numpy(), table.column("id").to_numpy()
        route = key if n == 1 else key >> BITS
        more = {c: table.column(c).to_numpy(zero_copy_only=False) for c in extra}
        x = dequantize(table.column("code"), dim)
        del table
        for r in np.unique(route):
            m = np.nonzero(route == r)[0]
            m = m[np.argsort(ids[m], kind="stable")]
            answers = _order(ids[m]) % np.uint64(copies) == np.uint64(r) if n == 1 else np.ones(len(m), bool)
            yield from run(0 if n == 1 else int(r), ids[m], x[m], axes, answers, {c: v[m] for c, v in more.items()})

    return ranged.mapInArrow(task, schema)


def neighbour_pairs(index: Index, k: int, floor: float) -> DataFrame:
    """(a, b, cos), a to b: of what ``a`` meets, ``b`` is among the k nearest, or one of the k smallest ids at equal cosine, at ``floor`` or more.

    ``index.reps`` may have a column ``query``: then only those rows ask.
    """
    f = index.forest
    one = ranges(index.rows, f) == 1
    extra = ("query",) if "query" in index.reps.columns else ()

    def run(route: int, ids: np.ndarray, x: np.ndarray, axes: np.ndarray, answers: np.ndarray, more: dict) -> Iterator[pa.RecordBatch]:
        asks = answers & more["query"].astype(bool) if extra else answers
        wide = replace(f, candidates=f.candidates * f.routes, trees=f.trees * f.routes) if one else f
        a, b, cos = nearest(x, np.nonzero(asks)[0], axes, k, floor, wide, f.seed + route)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(cos.astype(np.float64))], names=["a", "b", "cos"])

    schema = "a long, b long, cos double"
    if one or f.routes <= AT_ONCE:
        found = _ranges(index, run, schema, extra)
    else:
        index.reps, found = stage(index.reps, "reps"), None
        for first in range(0, f.routes, AT_ONCE):
            part = stage(_ranges(index, run, schema, extra, first, min(AT_ONCE, f.routes - first)), "near")
            found = part if found is None else found.unionByName(part)
            index.reps.sparkSession.sparkContext._jvm.System.gc()  # shuffle files of a pass go when its plan is collected
    # One copy of a pair from several ranges differs in the last digits at most.
    return found if one else found.groupBy("a", "b").agg(F.max("cos").alias("cos"))


def exact_pairs(index: Index, k: int, floor: float) -> DataFrame:
    """As ``neighbour_pairs``, without loss: every block of queries against every block of rows.

    Work grows with queries times rows; a task holds two blocks of ``BLOCK_ROWS`` and
    gives k rows for each query.
    """
    rows = index.reps if "query" in index.reps.columns else index.reps.withColumn("query", F.lit(True))
    asking = index.rows if "query" not in index.reps.columns else rows.where("query").count()
    nq, nr, dim = max(1, -(-asking // BLOCK_ROWS)), max(1, -(-index.rows // BLOCK_ROWS)), index.dim
    h = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    asks = rows.where("query").select(h(nq, 1).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("j"), "id", "code", F.lit(True).alias("asks"))
    base = rows.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("i"), h(nr, 2).alias("j"), "id", "code", F.lit(False).alias("asks"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        cell, ids, asks_ = t.column("i").to_numpy() * np.int64(nr) + t.column("j").to_numpy(), t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        x = dequantize(t.column("code"), dim)
        for c in np.unique(cell):
            q, m = np.nonzero((cell == c) & asks_)[0], np.nonzero((cell == c) & ~asks_)[0]
            m = m[np.argsort(ids[m], kind="stable")]
            if not len(m):
                continue
            for s0 in range(0, len(q), 512):
                part = q[s0 : s0 + 512]
                s = x[part] @ x[m].T
                at = np.minimum(np.searchsorted(ids[m], ids[part]), len(m) - 1)
                own = np.nonzero(ids[m][at] == ids[part])[0]
                s[own, at[own]] = -2
                a, b = _best(s, min(k, len(m)), max(floor, -1.5))
                yield pa.RecordBatch.from_arrays([pa.array(ids[part[a]]), pa.array(ids[m[b]]), pa.array(s[a, b].astype(np.float64))], names=["a", "b", "cos"])

    return asks.unionByName(base).repartition(nq * nr, "i", "j").mapInArrow(task, "a long, b long, cos double")


def _with_copies(near: DataFrame, copies: DataFrame, members: DataFrame, k: int, is_query=None) -> DataFrame:
    """(id, rank, neighbour, cos) from the neighbours ``near`` of representatives: classes of copies expanded on both sides.

    ``members`` are the copies that get rows; ``is_query`` says which other ids do.
    """
    by = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    # A class of copies stands behind each id: its k + 1 smallest ids can be neighbours.
    smallest = Window.partitionBy("rep").orderBy("id")
    first = stage(copies.withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids")), "firsts")
    first = broadcast_if_small(first)
    others = near.join(first.withColumnsRenamed({"rep": "b", "ids": "bs"}), "b", "left").select("a", F.explode(F.coalesce("bs", F.array("b"))).alias("b"), "cos")
    own = first.select(F.col("rep").alias("a"), F.explode("ids").alias("b"), F.lit(1.0).alias("cos"))
    listed = others.unionByName(own).withColumn("at", F.row_number().over(by)).where(F.col("at") <= k + 1).drop("at")
    each = listed.join(broadcast_if_small(members.withColumnRenamed("rep", "a")), "a", "left").withColumn("id", F.coalesce("id", "a")).where("id <> b")
    if is_query is not None:
        each = each.where(is_query)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "b"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", F.col("b").alias("neighbour"), "cos")


def _ranked(index: Index, near: DataFrame, k: int, members: DataFrame, is_query=None) -> DataFrame:
    by = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    near = near.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k)
    if index.copies.isEmpty():
        return near.select(F.col("a").alias("id"), F.col("at").alias("rank"), F.col("b").alias("neighbour"), "cos")
    return _with_copies(near.drop("at"), index.copies, members, k, is_query)


def top_k(vectors: DataFrame, k: int = 5, floor: float = 0.88, forest: Forest = Forest(), key: str = "vec_id", embedding: str = "embedding", exact: bool = False) -> DataFrame:
    """(id, rank, neighbour, cos): for every vector its k most similar at ``floor`` or more.

    Equal cosines rank by smaller id; a vector is never its own neighbour; copies rank
    with cosine 1. Vectors that take no part (see ``build``) give no row; an empty
    table gives none. ``exact`` compares everything, block by block.
    """
    index = build(vectors, forest, key, embedding, None if exact else floor)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "id long, rank int, neighbour long, cos double")
    near = (exact_pairs if exact else neighbour_pairs)(index, k, floor).where(F.col("cos") >= floor)
    return _ranked(index, near, k, index.copies)


def search(vectors: DataFrame, is_query, k: int = 5, forest: Forest = Forest(routes=4, candidates=32_768), key: str = "vec_id", embedding: str = "embedding", exact: bool = False) -> DataFrame:
    """(id, rank, neighbour, cos): the k most similar of all vectors for each query, however dissimilar.

    ``is_query`` is a Column over ``id``. Dissimilar vectors share short prefixes at
    most, so queries ascend to far more candidates than in ``top_k``. Copies rank with
    cosine 1, as there; each copy that is a query gets its own rows.
    """
    index = build(vectors, forest, key, embedding)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "id long, rank int, neighbour long, cos double")
    # A class of copies is asked for when any of its members is a query.
    members = stage(index.copies.where(is_query), "members")
    asked = broadcast_if_small(members.select(F.col("rep").alias("id")).distinct()).withColumn("asked", F.lit(True))
    index.reps = index.reps.join(asked, "id", "left").withColumn("query", F.coalesce(is_query, F.lit(False)) | F.col("asked").isNotNull()).drop("asked")
    return _ranked(index, (exact_pairs if exact else neighbour_pairs)(index, k, -2.0), k, members, is_query)


def _order(ids: np.ndarray) -> np.ndarray:
    """A hash of the ids that orders pivots (splitmix64)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def pivots(similar: np.ndarray, cos: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Parallel pivot clustering: in rounds, every free record that comes before all its free neighbours in the
    hash order becomes a pivot and absorbs them; members then go to their closest pivot. Gives each record's pivot."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(n)
    free, is_pivot = np.ones(n, bool), np.zeros(n, bool)
    while free.any():
        f = np.nonzero(free)[0]
        sub = similar[np.ix_(f, f)]
        before = np.where(sub, rank[f][None, :], n).min(axis=1)
        new = f[rank[f] <= before]
        is_pivot[new] = True
        free[new] = False
        free[similar[new].any(axis=0)] = False
    p = np.nonzero(is_pivot)[0]
    near = np.where(similar[:, p], cos[:, p], -2.0)
    near[p, np.arange(len(p))] = 2.0
    return p[near.argmax(axis=1)]


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links (a, b)."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, a, low)
        np.minimum.at(lab, b, low)
        lab = lab[lab]
        keep = lab[a] != lab[b]
        a, b = a[keep], b[keep]
    while True:
        nxt = lab[lab]
        if (nxt == lab).all():
            return lab
        lab = nxt


def _crowd(x: np.ndarray, order: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """As a leaf, for any number of rows that share a whole string: (pivot of each row, pairs of pivots joined by a link), in blocks."""
    n = len(x)
    by = np.argsort(order, kind="stable")
    free, found = np.ones(n, bool), []
    for i in by:
        if free[i]:
            found.append(i)
            free &= x @ x[i] < floor
            free[i] = False
    p = np.array(found)
    of = np.empty(n, np.int64)
    for s in range(0, n, 1024):
        c = x[s : s + 1024] @ x[p].T
        of[s : s + 1024] = p[c.argmax(axis=1)]
    of[p] = p
    bridges = [np.zeros(0, np.int64)]
    if len(p) > 1:
        for s in range(0, n, 256):
            u, v = np.nonzero(x[s : s + 256] @ x.T >= floor)
            a, b = of[u + s], of[v]
            bridges.append(np.unique(a[a < b] * n + b[a < b]))
    return of, np.unique(np.concatenate(bridges))


def links(index: Index, floor: float) -> DataFrame:
    """(id, hub, pivot, cos, h, g): for a record with links in a range, the smallest id it is joined to, its closest pivot there, and the hash order of both.

    A leaf's similar records go to pivots; pivots whose clusters share a link are
    bridged. In one range, pivots and bridges of all its trees are put together, so
    one row for each record leaves the task: what it is linked to, smallest id first.
    """
    f = index.forest
    trees = f.trees * f.routes if ranges(index.rows, f) == 1 else f.trees

    def run(route: int, ids: np.ndarray, x: np.ndarray, axes: np.ndarray, answers: np.ndarray, more: dict) -> Iterator[pa.RecordBatch]:
        if not answers.any():
            return
        ea, eb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        best, pivot_of = np.full(len(ids), -2.0), np.arange(len(ids))
        for tree in range(trees):
            for m in _local(x, axes, tree, f.seed + route, f.leaf):
                if len(m) > f.leaf:
                    act, n = np.arange(len(m)), len(m)
                    p, bridge = _crowd(x[m], _order(ids[m]), floor)
                    cos = np.einsum("ij,ij->i", x[m], x[m[p]])
                else:
                    s = x[m] @ x[m].T
                    np.fill_diagonal(s, -2)
                    act = np.nonzero(s.max(axis=1) >= floor)[0]
                    if not len(act):
                        continue
                    s = s[np.ix_(act, act)]
                    similar, n = s >= floor, len(act)
                    p = pivots(similar, s, _order(ids[m[act]]))
                    u, v = np.nonzero(similar & (p[:, None] < p[None, :]))
                    bridge = np.unique(p[u].astype(np.int64) * n + p[v])
                    cos = s[np.arange(n), p]
                ea += [m[act], m[act[bridge // n]]]
                eb += [m[act[p]], m[act[bridge % n]]]
                member = np.nonzero(p != np.arange(n))[0]
                closer = member[cos[member] > best[m[act[member]]]]
                best[m[act[closer]]] = cos[closer]
                pivot_of[m[act[closer]]] = m[act[p[closer]]]
        a, b = np.concatenate(ea), np.concatenate(eb)
        keep = a != b
        a, b = a[keep], b[keep]
        if not len(a):
            return
        lab = _labels(len(ids), a, b)
        linked = np.unique(np.concatenate([a, b]))
        # smallest id of each group, not smallest place
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, lab[linked], ids[linked])
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(low[lab[linked]]), pa.array(ids[pivot_of[linked]]), pa.array(best[linked]), *(pa.array((_order(z[linked]) >> np.uint64(1)).astype(np.int64)) for z in (ids, ids[pivot_of]))], names=["id", "hub", "pivot", "cos", "h", "g"])

    return _ranges(index, run, "id long, hub long, pivot long, cos double, h long, g long")


def pivot_rounds(similar: DataFrame) -> DataFrame:
    """(id, pivot, cos): parallel pivot clustering of the graph ``similar`` (a, b, cos, ha, hb), each edge once.

    In rounds, every free record that comes before all its free neighbours in the hash
    order (``ha`` of a, ``hb`` of b; then ids) becomes a pivot and absorbs them. Then
    each record goes to the closest pivot among its neighbours, equal ones by smaller
    id. A pivot is its own, with cosine 1.
    """
    node = lambda h, c: F.struct(F.col(h).alias("h"), F.col(c).alias("id"))
    one, two = node("ha", "a"), node("hb", "b")
    both = similar.select(one.alias("u"), two.alias("v"), "cos").unionByName(similar.select(two.alias("u"), one.alias("v"), "cos"))
    both = stage(both.where("u <> v").groupBy("u", "v").agg(F.max("cos").alias("cos")), "similar")
    edges, found = both.select("u", "v"), []
    while True:
        low = edges.groupBy("u").agg(F.min("v").alias("low"))
        new = stage(low.where("u < low").select("u"), "pivots")
        if new.isEmpty():
            unstage(new)
            break
        found.append(new)
        absorbed = edges.join(new.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        gone = stage(new.unionByName(absorbed).distinct(), "gone")
        left = stage(edges.join(gone, "u", "left_anti").join(gone.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v"), "left")
        # Free records that no free neighbour is left of come first of all they still have.
        alone = edges.select("u").distinct().join(gone, "u", "left_anti").join(left.select("u").distinct(), "u", "left_anti")
        found.append(stage(alone, "pivots"))
        unstage(edges), unstage(gone)
        edges = left
    chosen = both.select("u").where("false")
    for new in found:
        chosen = chosen.unionByName(new)
    chosen = stage(chosen, "chosen")
    for new in found:
        unstage(new)
    near = both.join(chosen.select(F.col("u").alias("v")), "v", "left_semi").join(chosen, "u", "left_anti")
    member = near.groupBy("u").agg(F.min(F.struct((-F.col("cos")).alias("far"), F.col("v.id").alias("p"))).alias("m")).select(F.col("u.id").alias("id"), F.col("m.p").alias("pivot"), (-F.col("m.far")).alias("cos"))
    own = chosen.select(F.col("u.id").alias("id"), F.col("u.id").alias("pivot"), F.lit(1.0).alias("cos"))
    return stage(member.unionByName(own), "assigned")


@dataclass
class Clustering:
    members: DataFrame  # id, pivot, cos: records with a link
    links: DataFrame  # id, hub
    copies: DataFrame


def cluster(vectors: DataFrame, floor: float = 0.88, forest: Forest = Forest(), key: str = "vec_id", embedding: str = "embedding") -> Clustering | None:
    """Parallel pivot clustering at ``floor``; None where no vector takes part.

    Records meet their neighbours in the leaves of the forest, where pivots absorb
    what is similar. The pivots that leaves propose compete in rounds across the
    cluster (``pivot_rounds``), and members go to the closest that is left.
    """
    index = build(vectors, forest, key, embedding)
    if index is None:
        return None
    found = stage(links(index, floor), "links")
    star = found.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"), "cos", F.col("h").alias("ha"), F.col("g").alias("hb"))
    return Clustering(pivot_rounds(star), found.select("id", "hub"), index.copies)


def pivot_clusters(vectors: DataFrame, floor: float = 0.88, least: int = 2, forest: Forest = Forest(), key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(cluster_id, vec_id): every record with its closest pivot, for clusters of ``least`` or more; ``cluster_id`` is the pivot.

    Copies go where their representative goes. Every member is within ``floor`` of its pivot.
    """
    made = cluster(vectors, floor, forest, key, embedding)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "cluster_id long, vec_id long")
    copies = made.copies.select(F.col("id").alias("vec_id"), F.col("rep").alias("id"))
    with_copies = made.members.select("id", "pivot").join(copies.where("vec_id <> id"), "id").select("vec_id", "pivot")
    alone = copies.join(made.members.select("id"), "id", "left_anti").select("vec_id", F.col("id").alias("pivot"))
    every = stage(made.members.select(F.col("id").alias("vec_id"), "pivot").unionByName(with_copies).unionByName(alone), "every")
    sizes = every.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return every.join(sizes, "pivot").select(F.col("pivot").alias("cluster_id"), "vec_id")


def clusters(vectors: DataFrame, floor: float = 0.88, least: int = 5, forest: Forest = Forest(), key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(cluster_id, vec_id): largest sets of records joined through links at ``floor``, of ``least`` or more.

    They are the pivot clusters put together where a link joins two. ``cluster_id`` is
    the smallest id. Exact copies are linked to each other. Vectors that take no part
    are in no cluster.
    """
    made = cluster(vectors, floor, forest, key, embedding)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "cluster_id long, vec_id long")
    pivot = made.members.select("id", "pivot")
    joined = made.links.join(pivot, "id").select(F.col("pivot").alias("a"), F.col("hub").alias("id")).distinct().join(pivot, "id").select("a", F.col("pivot").alias("b")).where("a <> b").distinct()
    parts = connected_components(joined, "a", "b").select(F.col("node").alias("pivot"), "component")
    placed = pivot.join(parts, "pivot", "left").select("id", F.coalesce("component", "pivot").alias("c"))
    copies = made.copies.select(F.col("id").alias("vec_id"), F.col("rep").alias("id"))
    with_copies = copies.where("vec_id <> id").join(placed, "id", "left").select(F.col("vec_id").alias("id"), F.coalesce("c", "id").alias("c"))
    alone = copies.where("vec_id = id").join(placed.select("id"), "id", "left_anti").select("id", F.col("id").alias("c"))
    every = stage(placed.unionByName(with_copies).unionByName(alone), "placed")
    named = every.groupBy("c").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return every.join(named, "c").select("cluster_id", F.col("id").alias("vec_id"))


def describe(vectors: DataFrame, members: DataFrame, name: str, k: int = 3, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(cluster_id, n_members, medoid, typical): size, most central member, and the names of the k most central ones.

    ``members`` is the result of ``pivot_clusters`` or ``clusters``. The medoid is the
    member with the largest sum of cosines to all: that is the one nearest to the sum of
    the unit vectors. Centroids are sums that are combined
    before the shuffle, so no cluster is gathered. Equal centrality goes by id.
    """
    inside = stage(members.withColumnRenamed("vec_id", "_id").join(vectors.select(F.col(key).alias("_id"), F.col(name).alias("_name"), F.col(embedding).alias("_vec")), "_id"), "inside")
    first = inside.select(F.size("_vec")).first()
    if first is None:
        return members.sparkSession.createDataFrame([], "cluster_id long, n_members long, medoid long, typical array<string>")
    middle = centroids(inside, ["cluster_id"], "_vec", first[0])
    best = representatives(inside, middle, ["cluster_id"], "_id", "_vec", k)
    named = best.join(inside.select("_id", "_name"), "_id")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("_name").alias("name")))), lambda x: x["name"])
    out = named.groupBy("cluster_id").agg(F.min_by("_id", "rank").alias("medoid"), ranked.alias("typical"))
    return out.join(middle.select("cluster_id", F.col("n").alias("n_members")), "cluster_id").select("cluster_id", "n_members", "medoid", "typical")
