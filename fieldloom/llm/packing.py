"""Filling containers of fixed capacity with texts, lexically similar ones together.

Texts are put in a lexical order: 64 signs of random sums over their words, weighted as
in BM25, so that texts with the same words stand together. Ranges of that order are the
shards. A shard holds an inverted index (words to texts, BM25 weights, document
frequencies of the whole corpus) and fills windows: the largest unused text is the seed,
its nearest unused texts follow while they fit, and what room is left goes to the largest
unused texts that still fit. Windows that stay loose are opened again and their texts go
to the next round, which has fewer shards and turns the signs, so that texts meet others,
until one shard is left. Texts longer than the capacity are cut at tokens.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import tokens
from fieldloom.llm.words import LETTER, Texts
from fieldloom.runtime import stage

K1, B = 1.5, 0.75
#: Texts in a shard: what the index of one task holds.
SHARD_ROWS = 2_000
#: Words are counted by this many hash buckets, which bounds the table of frequencies; few words share one.
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Words that this share of the corpus holds say nothing about nearness and retrieve nothing.
COMMON = 0.1
#: A window at least this full is closed.
FULL = 0.985
#: A round that leaves more than this share of its texts is the last.
STALLED = 0.6
DOCUMENT = -1  # ``cap`` of the row that stands for a whole text in the frequencies


def _words(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its words, as buckets, and how often it holds them."""
    t = Texts(texts)
    use = (t.kind == LETTER) & (t.end - t.start > 1)
    bucket = ((t.hash[use] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    both, n = np.unique((t.doc(t.start[use]) << BUCKET_BITS) | bucket, return_counts=True)
    cut = np.searchsorted(both >> BUCKET_BITS, np.arange(len(texts) + 1))
    b = (both & (BUCKETS - 1)).astype(np.int32)
    return [(b[i:j], n[i:j].astype(np.int32)) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def parts(documents: DataFrame, capacities: list[int], key: str, text: str, path: str) -> DataFrame:
    """(cap, id, part, n, w, c): pieces of at most ``cap`` tokens with their words (buckets) and counts.

    A text that fits every capacity is one piece with ``cap`` 0. Others have rows for
    each capacity: full pieces (no words, they need no company), then the rest; and one
    row with ``cap`` DOCUMENT that holds all their words. Null and empty texts hold no
    tokens and need no container.
    """
    kind = documents.schema[key].dataType
    least = min(capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                ids, texts = (batch.column(k).slice(first, 500).to_pylist() for k in (0, 1))
                rows, said = [], []
                for i, t in zip(ids, texts, strict=True):
                    if not t:
                        continue
                    toks = [x for p in tokens.pieces(t) for x in enc.encode_ordinary(p)]
                    if len(toks) <= least:
                        rows.append((0, i, 0, len(toks))), said.append(t)
                        continue
                    rows.append((DOCUMENT, i, 0, len(toks))), said.append(t)
                    for cap in capacities:
                        if len(toks) <= cap:
                            rows.append((cap, i, 0, len(toks))), said.append(t)
                            continue
                        for k, s in enumerate(range(0, len(toks), cap)):
                            n = min(cap, len(toks) - s)
                            rows.append((cap, i, k, n)), said.append(enc.decode(toks[s:]) if n < cap else "")
                words = _words(said)
                a = list(zip(*rows, strict=True)) or [[]] * 4
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x[k]) for x in words])]), pa.int32()), pa.array(np.concatenate([x[k] for x in words]) if words else np.zeros(0, np.int32), pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int32()), pa.array(a[1], batch.schema.field(0).type), *(pa.array(a[k], pa.int32()) for k in (2, 3)), *lists], names=["cap", "id", "part", "n", "w", "c"])

    return documents.select(key, text).mapInArrow(run, f"cap int, id {kind.simpleString()}, part int, n int, w array<int>, c array<int>")


def frequencies(pieces: DataFrame) -> tuple[np.ndarray, int]:
    """(texts that hold each bucket, number of texts), over the whole corpus; each text counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=BUCKETS)
            rows += batch.num_rows
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]).astype(np.int32)), pa.array(np.concatenate([[rows], total[at]]))], names=["b", "n"])

    whole = pieces.where(F.col("cap") <= 0).select("w")
    found = whole.mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    b, n = found.column("b").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(BUCKETS, np.int32)
    out[b[b >= 0]] = n[b >= 0]
    return out, int(n[b < 0].sum())


def _idf(df: np.ndarray, corpus: int) -> np.ndarray:
    """Weights of words; 0 for common ones."""
    d = df.astype(np.float32)
    return np.where((d <= max(1.0, COMMON * corpus)) & (d > 0), np.log1p((corpus - d + 0.5) / (d + 0.5)), 0).astype(np.float32)


def signatures(flat: np.ndarray, counts: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """64 signs of random sums over the words of each text, as one number."""
    weight = (idf[flat] * counts * (K1 + 1) / (counts + K1)).astype(np.float32)
    x = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    out = np.zeros(len(offsets) - 1, np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for i in range(64):
        s = np.bincount(row, np.where((x >> np.uint64(i)) & np.uint64(1), weight, -weight), len(out))
        out |= (s > 0).astype(np.uint64) << np.uint64(i)
    return out.view(np.int64)


def fill(sizes: np.ndarray, words: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows over one shard, as lists of places."""
    n = len(sizes)
    length = np.array([c.sum() for c in counts], np.float32)
    avg = float(length.mean()) if n and length.any() else 1.0
    row = np.repeat(np.arange(n), [len(w) for w in words])
    flat = np.concatenate(words) if n else np.zeros(0, np.int32)
    f = (np.concatenate(counts) if n else np.zeros(0, np.int32)).astype(np.float32)
    weight = idf[flat] * f * (K1 + 1) / (f + K1 * (1 - B + B * length[row] / avg))
    used = np.nonzero(weight > 0)[0]
    # The inverted index: texts and weights by word.
    order = used[np.argsort(flat[used], kind="stable")]
    word, first = np.unique(flat[order], return_index=True)
    ends = np.append(first[1:], len(order))
    posted, weights = row[order], weight[order]
    own = [word.searchsorted(w[idf[w] > 0]) for w in words]
    keys = sorted(zip(sizes.tolist(), range(n), strict=True))
    free = np.ones(n, bool)
    out = []

    def take(i: int) -> None:
        free[i] = False
        keys.pop(bisect.bisect_left(keys, (int(sizes[i]), i)))

    while keys:
        seed = keys[-1][1]
        take(seed)
        window, room = [seed], capacity - int(sizes[seed])
        if keys and keys[0][0] <= room and len(own[seed]):
            a, z = first[own[seed]], ends[own[seed]]
            at = np.repeat(a - np.concatenate([[0], np.cumsum(z - a)[:-1]]), z - a) + np.arange(int((z - a).sum()))
            score = np.bincount(posted[at], weights[at], n)
            near = np.nonzero((score > 0) & free & (sizes <= room))[0]
            for i in near[np.argsort(-score[near], kind="stable")]:
                if not keys or keys[0][0] > room:
                    break
                if sizes[i] <= room:
                    take(int(i))
                    window.append(int(i))
                    room -= int(sizes[i])
        while keys and keys[0][0] <= room:
            i = keys[bisect.bisect_right(keys, (room, n)) - 1][1]
            take(i)
            window.append(i)
            room -= int(sizes[i])
        out.append(window)
    return out


def pack(documents: DataFrame, capacities: dict[str, int], key: str = "doc_id", text: str = "text", path: str = tokens.VOCABULARY) -> DataFrame:
    """(kind, container, id, part, n, slot): for each kind of container, every piece of every text in exactly one.

    ``slot`` orders the pieces of a container from 1; ``container`` is unique within its
    kind. Repeated texts are pieces of their own; repeated ids keep all rows. An empty
    table needs no containers.
    """
    pieces = stage(parts(documents, sorted(set(capacities.values())), key, text, path), "pieces")
    df, corpus = frequencies(pieces)
    shared = documents.sparkSession.sparkContext.broadcast(_idf(df, corpus))
    id_type = documents.schema[key].dataType.simpleString()
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("capacity")) for k, c in capacities.items())))
    used = pieces.where(F.col("cap") >= 0)
    each = used.select(kinds.alias("to"), "*").where("cap = 0 or cap = to.capacity").select("to.kind", "to.capacity", "id", "part", "n", "w", "c")
    full = each.where("n = capacity").select("kind", F.concat(F.lit("full-"), F.col("id").cast("string"), F.lit("-"), F.col("part").cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string")).alias("container"), "id", "part", "n", F.lit(1).alias("slot"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, c = b.column(4), b.column(5)
            off = np.concatenate([[0], np.cumsum(w.value_lengths().to_numpy(zero_copy_only=False))])
            sig = signatures(w.flatten().to_numpy(), c.flatten().to_numpy(), off, shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig)], names=[*b.schema.names, "sig"])

    loose = used.where(f"n < {max(capacities.values())}")
    signed = loose.mapInArrow(sign, f"cap int, id {id_type}, part int, n int, w array<int>, c array<int>, sig long")
    rest = signed.select(kinds.alias("to"), "*").where("(cap = 0 or cap = to.capacity) and n < to.capacity").select("to.kind", "to.capacity", "id", "part", "n", "w", "c", "sig")
    done, step, left = [full], 0, each.where("n < capacity").count()
    schema = f"kind string, container string, capacity int, id {id_type}, part int, n int, w array<int>, c array<int>, sig long, slot int"
    stalled = False
    while left:
        shards = max(1, -(-left // SHARD_ROWS))
        last = shards == 1 or stalled

        def task(batches: Iterator[pa.RecordBatch], step=step, last=last) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            from pyspark import TaskContext

            t = pa.Table.from_batches(held).combine_chunks()
            shard, kind = TaskContext.get().partitionId(), np.array(t.column("kind").to_pylist(), object)
            for name in sorted(set(kind)):
                p = t.take(pa.array(np.nonzero(kind == name)[0])).sort_by([("id", "ascending"), ("part", "ascending")])
                capacity, sizes = p.column("capacity")[0].as_py(), p.column("n").to_numpy()
                lists = [p.column(c).combine_chunks() for c in ("w", "c")]
                w, c = (np.split(x.flatten().to_numpy(), np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))[:-1]) for x in lists)
                at, container, slot, closed = [], [], [], []
                for k, window in enumerate(fill(sizes, w, c, shared.value, capacity)):
                    shut = last or sizes[window].sum() >= FULL * capacity
                    at += window
                    container += [f"{step}-{shard}-{k}" if shut else None] * len(window)
                    closed += [shut] * len(window)
                    slot += range(1, len(window) + 1)
                q = p.take(pa.array(at))
                # Words travel on only with texts that go to the next round.
                gone = pa.array(closed)
                kept = [pc.if_else(gone, pa.scalar(None, q.schema.field(x).type), q.column(x).combine_chunks()) for x in ("w", "c")]
                cols = [q.column("kind"), pa.array(container, pa.string()), q.column("capacity"), q.column("id"), q.column("part"), q.column("n"), *kept, q.column("sig"), pa.array(slot, pa.int32())]
                yield from pa.Table.from_arrays(cols, names=["kind", "container", "capacity", "id", "part", "n", "w", "c", "sig", "slot"]).combine_chunks().to_batches()

        # Turned signs: other bits lead in each round.
        turn = (step * 11) % 64
        order = F.col("sig") if not turn else F.shiftleft("sig", turn).bitwiseOR(F.shiftrightunsigned("sig", 64 - turn))
        made = stage(rest.repartitionByRange(shards, F.col("kind"), order, F.xxhash64("id", "part")).mapInArrow(task, schema), "windows")
        done.append(made.where("container is not null").select("kind", "container", "id", "part", "n", "slot"))
        rest, before = made.where("container is null").drop("container", "slot"), left
        left = rest.count()
        # Where too little closes, the next round is the last, in as many shards as it takes.
        stalled = left > STALLED * before
        step += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(kind, containers, pieces, tokens, filled): how many containers of a kind, and the share of their room used."""
    size = F.element_at(F.create_map(*(F.lit(x) for kc in capacities.items() for x in kc)), F.col("kind"))
    each = packed.groupBy("kind").agg(F.countDistinct("container").alias("containers"), F.count("*").alias("pieces"), F.sum("n").alias("tokens"))
    return each.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * size), 4))
