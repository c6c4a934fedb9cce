"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors of integers are put in an order that keeps like ones together and cut
into shards of document-range blocks. A block has its forward index (the
vectors) and, per term (component), its largest and least value; so has a shard.
For a query the sum over terms of what the extremes allow bounds every score
inside. Blocks are taken in the order of their bounds and scored until the
bounds fall below the query's k-th score.

A query begins in the shard that it stands in. Its k-th score there is held
against the extremes of all shards, and only (query, shard) pairs that may still
better it are shipped; there blocks are pruned in the same way.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinthread.llm.common import stored

SCALE = 256
BLOCK = 256
#: Vectors of a shard, at most.
SHARD = 8192
#: Home shards whose queries travel together.
TOGETHER = 64
#: Shards whose extremes are held against queries at once, and home shards whose queries are.
EXTREMES, ASKING = 4096, 1024
#: Hyperplanes of the ordering code.
PLANES = 24
#: Whole numbers below this are exact in doubles; scores below WIDE are kept as 64-bit integers.
EXACT, WIDE = 2.0**53, 2.0**62
#: Rows that one row is multiplied to at once.
TIMES = 1 << 16


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the vectors that take part: an id, and finite components only."""
    values = F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), values.alias("x")
    )


def quantised(matrix: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): whole numbers, exact as doubles, since scaling by a power of two rounds nothing."""
    scaled = np.floor(matrix * SCALE)
    if not np.isfinite(scaled).all():
        raise ValueError(f"a component times {SCALE} is no double")
    return scaled + 0.0  # no negative zero


def order_code(matrix: np.ndarray) -> np.ndarray:
    """A code by the sides of seeded hyperplanes: like vectors often agree in the first bits."""
    planes = np.random.default_rng(7).normal(size=(matrix.shape[1], PLANES))
    unit = matrix / np.maximum(np.abs(matrix).max(axis=1, initial=0, keepdims=True), 1)
    return ((unit @ planes) > 0) @ (1 << np.arange(PLANES)[::-1])


def _whole(matrix: np.ndarray) -> np.ndarray:
    """Python's integers of whole-numbered doubles."""
    out = np.empty(matrix.shape, dtype=object)
    out[...] = [[int(x) for x in row] for row in matrix.tolist()]
    return out


def _reach(a: np.ndarray) -> np.ndarray:
    """Largest magnitude of every row."""
    return np.abs(a).max(axis=1, initial=0).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole-numbered doubles, exact: 64-bit integers, or Python's where those might not do.

    Doubles do as long as every partial sum is below EXACT. Rows that are too
    large for that are multiplied in Python's integers, those alone.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    width, reach_a, reach_b = a.shape[1], _reach(a), _reach(b)
    if reach_a.max() * reach_b.max() * width < EXACT:
        return (a @ b.T).astype(np.int64)
    limit = math.sqrt(EXACT / width) * (1 - 1e-9)
    big_a, big_b = np.flatnonzero(reach_a >= limit), np.flatnonzero(reach_b >= limit)
    small_a, small_b = np.flatnonzero(reach_a < limit), np.flatnonzero(reach_b < limit)
    wide = reach_a.max() * reach_b.max() * width >= WIDE
    out = np.empty((len(a), len(b)), dtype=object if wide else np.int64)
    out[np.ix_(small_a, small_b)] = (a[small_a] @ b[small_b].T).astype(np.int64)
    if len(big_a):
        out[big_a] = _whole(a[big_a]).dot(_whole(b).T)
    if len(big_b) and len(small_a):
        out[np.ix_(small_a, big_b)] = _whole(a[small_a]).dot(_whole(b[big_b]).T)
    return out


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """No vector between the extremes scores more: positive terms at most, negative ones at least."""
    return products(np.maximum(queries, 0), most) + products(np.minimum(queries, 0), least)


class Shard:
    """Blocks of a run of vectors; ``times`` tells how often a row repeats."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, times: np.ndarray | None = None):
        self.ids, self.matrix = ids, matrix.astype(np.float64)
        self.times = np.ones(len(ids), dtype=np.int64) if times is None else times
        self.cuts = list(range(0, len(ids), BLOCK)) + [len(ids)]
        spans = list(zip(self.cuts[:-1], self.cuts[1:], strict=True))
        self.most = np.array([self.matrix[a:b].max(axis=0) for a, b in spans])
        self.least = np.array([self.matrix[a:b].min(axis=0) for a, b in spans])
        self.first = np.array([ids[a:b].min() for a, b in spans])


#: A candidate that beats nothing: (-score, vec_id).
NOTHING = (1 << 2200, 0)


def search_shard(shard: Shard, queries: np.ndarray, k: int, best: list[list[tuple]], own: np.ndarray | None = None, limits=None) -> int:
    """Bring ``best`` (per query the k best (-score, vec_id, times), sorted) up to date; returns blocks scored.

    ``own`` are the queries' own positions in the shard, which they don't find.
    ``limits`` (-score, vec_id) are what candidates have to beat beside ``best``.
    """
    if not len(queries) or not len(shard.ids):
        return 0
    bound = bounds(queries, shard.most, shard.least)
    order = np.argsort(-bound, axis=1, kind="stable")
    rows = np.arange(len(queries))
    scored = 0

    def threshold(i: int) -> tuple[int, int]:
        held = NOTHING if limits is None else limits[i]
        return min(held, best[i][-1][:2]) if len(best[i]) == k else held

    limit = [threshold(i) for i in rows.tolist()]
    small = bound.dtype != object and all(abs(s) < WIDE or s == NOTHING[0] for s, _ in limit)
    kind = np.int64 if small else object
    worst = np.array([min(s, 1 << 62) if small else s for s, _ in limit], dtype=kind)
    worst_id = np.array([d for _, d in limit], dtype=np.int64)
    for turn in range(bound.shape[1]):
        block = order[:, turn]
        least = -bound[rows, block]
        # a block whose bound equals the k-th score still matters if it has a smaller id
        open_ = ((least < worst) | ((least == worst) & (shard.first[block] < worst_id))).astype(bool)
        if not open_.any() and (least > worst).all():
            break
        for b in np.unique(block[open_]).tolist():
            mine = np.flatnonzero(open_ & (block == b))
            low, high = shard.cuts[b], shard.cuts[b + 1]
            scores = -products(queries[mine], shard.matrix[low:high])
            ids, times = shard.ids[low:high], shard.times[low:high]
            scored += len(mine)
            keep = (scores <= worst[mine][:, None]).astype(bool)
            if own is not None:
                keep &= np.arange(low, high)[None, :] != own[mine][:, None]
            for r in np.flatnonzero(keep.any(axis=1)).tolist():
                i = int(mine[r])
                s, d, n = scores[r, keep[r]], ids[keep[r]], times[keep[r]]
                if len(s) > k:
                    top = np.lexsort((d, s))[:k] if s.dtype != object else sorted(range(len(s)), key=lambda j: (s[j], d[j]))[:k]
                    s, d, n = s[top], d[top], n[top]
                held = threshold(i)
                best[i] = sorted([*best[i], *(c for c in zip(s.tolist(), d.tolist(), n.tolist(), strict=True) if c[:2] <= held)])[:k]
                limit_s, worst_id[i] = threshold(i)
                worst[i] = min(limit_s, 1 << 62) if small else limit_s
    return scored


def _pack(matrix: np.ndarray) -> bytes:
    """Whole-numbered doubles in four bytes each where that is exact, as it is for vectors of floats."""
    with np.errstate(over="ignore"):
        narrow = matrix.astype("<f4")
    return (narrow if (narrow == matrix).all() else matrix.astype("<f8")).tobytes()


def _matrix(data: bytes, dim: int, count: int) -> np.ndarray:
    kind = "<f4" if len(data) == 4 * dim * count else "<f8"
    return np.frombuffer(data, dtype=kind).reshape(count, dim).astype(np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to smaller vec_id.

    ``vectors`` has (vec_id, embedding); ``is_query`` is a condition on vec_id.
    Candidates of a query are all rows but its own: repeated rows, of the
    query's too, are candidates and queries each; different vectors under one
    vec_id are searched and found each. A query with fewer candidates gets all.
    Rows with a null id or vector, or with null or non-finite components, take
    no part. Vectors meet only those of their own length. No rows, no result.
    Further columns are ignored. Components may have any size; a score among
    the k best that doesn't fit a long is an error, never a wrong number.

    Exact: a (query, shard) pair is left out only if the shard's extremes bound
    it below the k-th score that the query has at home. Groups that meet in a
    task are one shard and the queries of TOGETHER shards, whatever the table's
    size; equal rows travel once, with their number.
    """
    rows = taking_part(vectors).withColumn("is_query", F.coalesce(is_query, F.lit(False)))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            size = np.array([len(x) for x in part["x"]])
            for dim in np.unique(size).tolist():
                mine = part[size == dim]
                matrix = quantised(np.array([np.asarray(x, dtype=np.float64) for x in mine["x"]]).reshape(len(mine), dim))
                yield pd.DataFrame({
                    "dim": dim, "code": order_code(matrix), "vec_id": mine["vec_id"],
                    "is_query": mine["is_query"], "q": [_pack(x) for x in matrix],
                })

    keys = ["dim", "code", "vec_id", "is_query", "q"]
    coded = stored(
        rows.mapInPandas(code, "dim int, code long, vec_id long, is_query boolean, q binary")
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("times")), "vectors",
    )
    count = coded.count()
    kinds = "shard long, dim int, n int, ids binary, times binary, data binary, queries binary"

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 12, []

        def made(parts: list[pd.DataFrame], at: int) -> pd.DataFrame:
            part = pd.concat(parts)
            dim = int(part["dim"].iloc[0])
            matrix = np.concatenate([_matrix(q, dim, 1) for q in part["q"]])
            return pd.DataFrame({
                "shard": [number + at], "dim": [dim], "n": [len(part)], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                "times": [part["times"].to_numpy(np.int64).tobytes()], "data": [_pack(matrix)],
                "queries": [part["is_query"].to_numpy(np.uint8).tobytes()],
            })

        at = 0
        for batch in batches:
            for _, same in batch.groupby("dim", sort=False):
                for low in range(0, len(same), SHARD):
                    part = same[low : low + SHARD]
                    if held and (held[0]["dim"].iloc[0] != part["dim"].iloc[0] or sum(map(len, held)) + len(part) > SHARD):
                        yield made(held, at)
                        held, at = [], at + 1
                    held.append(part)
        if held:
            yield made(held, at)

    place = F.xxhash64("q")  # parts even a vec_id that many vectors share
    shards = stored(
        coded.repartitionByRange(max(1, -(-count // (SHARD * 3 // 4))), "dim", "code", "vec_id", place)
        .sortWithinPartitions("dim", "code", "vec_id", place).mapInPandas(build, kinds), "shards",
    )

    def opened(row) -> Shard:
        return Shard(np.frombuffer(row.ids, dtype=np.int64), _matrix(row.data, row.dim, row.n), np.frombuffer(row.times, dtype=np.int64))

    query_kind = "home long, dim int, n int, queries binary, ids binary, times binary, data binary, best binary"

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                asked = np.flatnonzero(np.frombuffer(row.queries, dtype=np.uint8) == 1)
                if not len(asked):
                    continue
                shard = opened(row)
                for at in range(0, len(asked), 512):
                    mine = asked[at : at + 512]
                    matrix = shard.matrix[mine]
                    # a repeated query finds its own copies
                    best: list[list[tuple]] = [
                        [(-int(products(matrix[i : i + 1], matrix[i : i + 1])[0, 0]), int(shard.ids[j]), int(shard.times[j]) - 1)]
                        if shard.times[j] > 1 else [] for i, j in enumerate(mine.tolist())
                    ]
                    search_shard(shard, matrix, k, best, mine)
                    yield pd.DataFrame({
                        "home": [row.shard], "dim": [row.dim], "n": [len(mine)], "queries": [(row.shard * SHARD + mine).astype(np.int64).tobytes()],
                        "ids": [shard.ids[mine].tobytes()], "times": [shard.times[mine].tobytes()], "data": [_pack(matrix)],
                        "best": [json.dumps(best).encode()],
                    })

    queries = stored(shards.mapInPandas(at_home, query_kind), "queries")

    # which shards may better a query: their extremes against its k-th score at home
    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                matrix = _matrix(row.data, row.dim, row.n)
                yield pd.DataFrame({
                    "shard": [row.shard], "dim": [row.dim], "first": [int(np.frombuffer(row.ids, dtype=np.int64).min())],
                    "most": [_pack(matrix.max(axis=0))], "least": [_pack(matrix.min(axis=0))],
                })

    numbered = "shard long, dim int, first long, most binary, least binary"
    edges = stored(shards.select("shard", "dim", "n", "ids", "data").mapInPandas(extremes, numbered), "extremes")
    chunks, parts = (max(1, -(-n // size)) for n, size in ((edges.count(), EXTREMES), (edges.count(), ASKING)))
    every_chunk, every_part = F.sequence(F.lit(0), F.lit(chunks - 1)), F.sequence(F.lit(0), F.lit(parts - 1))
    asking = queries.select("home", "dim", "n", "queries", "ids", "times", "data", "best").withColumns({
        "part": F.pmod(F.xxhash64("home"), F.lit(parts)).cast("int"), "chunk": F.explode(every_chunk),
    })
    held = edges.withColumns({"chunk": F.pmod(F.xxhash64("shard"), F.lit(chunks)).cast("int"), "part": F.explode(every_part)})
    travel = "shard long, bundle long, dim int, n int, queries binary, ids binary, times binary, data binary, limits binary"

    def reached(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, same in known.groupby("dim"):
            most = np.concatenate([_matrix(x, dim, 1) for x in same["most"]])
            least = np.concatenate([_matrix(x, dim, 1) for x in same["least"]])
            first, shard = same["first"].to_numpy(np.int64), same["shard"].to_numpy(np.int64)
            for row in asked[asked["dim"] == dim].itertuples():
                matrix = _matrix(row.data, dim, row.n)
                limits = [tuple(b[-1][:2]) if len(b) == k else NOTHING for b in json.loads(row.best)]
                top = -bounds(matrix, most, least)
                worst = np.array([s for s, _ in limits], dtype=object)[:, None]
                if top.dtype != object:
                    worst = np.clip(worst, -(1 << 62), 1 << 62).astype(np.int64)
                may = (top < worst) | ((top == worst) & (first[None, :] < np.array([d for _, d in limits], dtype=np.int64)[:, None]))
                may = may.astype(bool) & (shard != row.home)[None, :]
                columns = [np.frombuffer(getattr(row, c), dtype=np.int64) for c in ("queries", "ids", "times")]
                for j in np.flatnonzero(may.any(axis=0)).tolist():
                    pick = np.flatnonzero(may[:, j])
                    out.append((
                        int(shard[j]), row.home // (TOGETHER << 12), dim, len(pick), *(c[pick].tobytes() for c in columns),
                        _pack(matrix[pick]), json.dumps([limits[i] for i in pick.tolist()]).encode(),
                    ))
        return pd.DataFrame(out, columns=["shard", "bundle", "dim", "n", "queries", "ids", "times", "data", "limits"])

    keys = ["chunk", "part"]
    shipped = stored(asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(reached, travel), "shipped")
    wanted = shipped.select(F.col("shard").alias("of"), F.col("bundle").alias("to")).distinct()
    left = shards.drop("queries").join(wanted, F.col("shard") == F.col("of")).drop("of").withColumnRenamed("to", "bundle")
    kind = "query long, query_id long, query_times long, vec_id long, score long, times long"
    names = [part.split()[0] for part in kind.split(", ")]

    def found_rows(number, ids, times, best) -> list[tuple]:
        out = []
        for q, i, m, b in zip(number, ids, times, best, strict=True):
            for s, d, n in b:
                if not -(1 << 63) <= -s < 1 << 63:
                    raise OverflowError(f"the score of {i} and {d} does not fit a long")
                out.append((int(q), int(i), int(m), d, -s, n))
        return out

    def of_packet(row):
        return (np.frombuffer(getattr(row, c), dtype=np.int64) for c in ("queries", "ids", "times"))

    def meet(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in mine.itertuples():
            shard = opened(row)
            for q in asked.itertuples():
                best: list[list[tuple]] = [[] for _ in range(q.n)]
                search_shard(shard, _matrix(q.data, q.dim, q.n), k, best, limits=[tuple(x) for x in json.loads(q.limits)])
                out += found_rows(*of_packet(q), best)
        return pd.DataFrame(out, columns=names)

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q in batch.itertuples():
                yield pd.DataFrame(found_rows(*of_packet(q), json.loads(q.best)), columns=names)

    keys = ["shard", "bundle"]
    found = queries.mapInPandas(known, kind).union(left.groupBy(*keys).cogroup(shipped.groupBy(*keys)).applyInPandas(meet, kind))
    # a row's copies are found and asked each
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= k)
    best = best.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("query_times") - 1) / TIMES))))
    run = F.least(F.lit(TIMES), F.col("query_times") - F.col("run") * TIMES).cast("int")
    best = best.withColumn("asked", F.explode(F.sequence(F.lit(1), run)))
    return best.select("query_id", "rank", "vec_id", "score")
