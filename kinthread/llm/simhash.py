"""SimHash near duplicates by anchor-point covering.

Fingerprints of 64 bits are compared only where they meet at an *anchor*, a
codeword of a linear covering code. Let r(f) be the distance from f to its
nearest codeword, its home (at most the covering radius). A fingerprint goes to
every anchor within r(f) + threshold. For two fingerprints at most ``threshold``
bits apart, take the one with the smaller r as f: the other, g, lies within
r(f) + threshold <= r(g) + threshold of f's home, so the two meet there. No link
is lost, whatever the code; the code only decides how many anchors are visited.

The visits grow with the code's dimension, so the code stops growing at MOST_BITS.
In larger tables an anchor's fingerprints are cut once more: into threshold + 1
blocks of bits, of which two that differ in at most ``threshold`` bits share one.
They meet at (anchor, block, the block's bits), so visits stay below 50 at any size.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinthread.llm.common import SALTS, connected_components, row_hash, spread_join, stored

BITS = 64
SHINGLE = 3
THRESHOLD = 3
SEED = 42
#: Mean number of fingerprints at home at one anchor that the code's size aims at.
HOMES = 128
#: Homes in one comparison; anchors with more are cut into a grid of cells.
CELL = 1024
#: At most so many anchors can be cut, so their list is small at any size.
HOT_ANCHORS = 50_000
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Largest dimension of the code; with more homes an anchor than MOST_HOMES a code of CUT_BITS, whose anchors are cut.
MOST_BITS, CUT_BITS, MOST_HOMES = 12, 9, 1024


def _runs(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data``, about ``size`` bytes at a time."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + size)
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of ``text``: bit set if in over half the shingles' XXH64 (repeats count).

    A very long text is hashed a run of words at a time.
    """
    total, count, words = np.zeros(BITS, dtype=np.int64), 0, []

    def add(grams: list[bytes]) -> None:
        nonlocal total, count
        total += bit_counts(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8"))
        count += len(grams)

    for run in _runs((text or "").encode("utf-8", "surrogatepass").lower()):
        words = words[max(0, len(words) - shingle + 1) :] + run
        grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
        for at in range(0, len(grams), 8192):
            add(grams[at : at + 8192])
    if not count:
        if not words:
            return 0
        add([b" ".join(words)])
    return majority(total, count)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(total: np.ndarray, count: int) -> int:
    """The fingerprint of ``count`` hashes with these bit counts."""
    return int(np.packbits((total * 2 > count).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, same, fp): one row per row; fp has the fingerprint's 64 bits in a signed long.

    ``same`` is a hash of the text, by which rows of one doc_id are told apart.
    """

    @F.pandas_udf("long")
    def of_text(text: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t if isinstance(t, str) else None, shingle) for t in text], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("same"), of_text("text").alias("fp"))


@functools.lru_cache(maxsize=8)
def covering_code(dimension: int) -> np.ndarray:
    """The 2**dimension anchors: of eight seeded random linear codes that with the fewest anchors within threshold of the nearest."""
    rng = np.random.default_rng(2024)
    probe = rng.integers(0, 2**64, size=256, dtype=np.uint64)
    best = None
    for _ in range(8):
        words = np.zeros(1, dtype=np.uint64)
        for basis in rng.integers(1, 2**64, size=dimension, dtype=np.uint64):
            words = np.concatenate([words, words ^ basis])
        d = np.bitwise_count(probe[:, None] ^ words[None, :]).astype(np.int16)
        cost = (d <= d.min(axis=1)[:, None] + THRESHOLD).sum()
        if best is None or cost < best[0]:
            best = (cost, words)
    return best[1]


def plan(count: int) -> tuple[int, int]:
    """(dimension of the code, bits of a block that anchors are cut by) for so many fingerprints."""
    if count <= MOST_HOMES << MOST_BITS:
        return min(MOST_BITS, max(4, round(math.log2(max(2, count) / HOMES)))), 0
    return CUT_BITS, min(BITS // (THRESHOLD + 1), math.ceil(math.log2(count / (HOMES << CUT_BITS))))


def anchors_of(fps: np.ndarray, dimension: int, threshold: int = THRESHOLD, width: int = 0):
    """(row, anchor, at_home): each fingerprint's anchors within r + threshold, cut by blocks of ``width`` bits if any."""
    words = covering_code(dimension)
    d = np.bitwise_count(fps[:, None] ^ words[None, :])
    over = d - d.min(axis=1)[:, None]
    rows, anchor = np.nonzero(over <= threshold)
    home = anchor == over.argmin(axis=1)[rows]
    if not width:
        return rows, anchor.astype(np.int64), home
    # all blocks, whatever ``threshold`` is here: a cell's name must not depend on it
    blocks = THRESHOLD + 1
    block = np.tile(np.arange(blocks), len(rows))
    rows, anchor, home = (np.repeat(x, blocks) for x in (rows, anchor, home))
    value = (fps[rows] >> (block * (BITS // blocks)).astype(np.uint64)) & np.uint64(2**width - 1)
    return rows, ((anchor * blocks + block) << width) + value.astype(np.int64), home


class Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_links(fps: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links (positions) spanning the same groups as all links between homes and members.

    Never more links than members: a large group of near copies gives a tree,
    not its pairs.
    """
    at_home = np.nonzero(home)[0]
    if not len(at_home) or len(fps) < 2:
        return []
    forest, out, budget = Forest(len(fps)), [], 16 * len(fps)
    step = max(1, (1 << 22) // len(fps))
    for at in range(0, len(at_home), step):
        mine = at_home[at : at + step]
        a, b = np.nonzero(np.bitwise_count(fps[mine][:, None] ^ fps[None, :]) <= threshold)
        a = mine[a]
        budget -= len(a)
        if budget < 0:
            return _search(fps, home, threshold)
        for x, y in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True):
            if forest.link(x, y):
                out.append((x, y))
    return out


def _search(fps: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Breadth-first search over the members not reached yet: for dense groups."""
    left = np.ones(len(fps), dtype=bool)
    out = []
    for start in np.nonzero(home)[0].tolist():
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            rest = np.nonzero(left if home[x] else left & home)[0]
            if not len(rest):
                continue
            near = rest[np.bitwise_count(fps[rest] ^ fps[x]) <= threshold]
            left[near] = False
            out.extend((x, y) for y in near.tolist())
            queue.extend(near.tolist())
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def links(nodes: DataFrame, count: int, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v) links between distinct fingerprints ``nodes`` (fp) that span every group.

    The code grows with ``count`` so that an anchor keeps about HOMES homes, up
    to a limit; then anchors are cut (see plan). Links of more bits than
    THRESHOLD would need other blocks. Anchors of a dense group that are home to more than CELL (or to more than a
    HOT_ANCHORS-th of all) are cut into a grid: a chunk of homes meets a chunk
    of members in each cell, so no task holds a whole group.
    """
    dimension, width = plan(count)
    if threshold > THRESHOLD:
        raise ValueError(f"links of more than {THRESHOLD} bits")

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            fps = part["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(fps), 1024):
                _, anchor, home = anchors_of(fps[at : at + 1024], dimension, 0, width)
                yield pd.DataFrame({"anchor": anchor[home]})

    cell = max(CELL, count // HOT_ANCHORS)
    hot = {
        row["anchor"]: -(-row["n"] // cell)
        for row in nodes.select("fp").mapInPandas(homes, "anchor long")
        .groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
        .collect()  # at most count / cell <= HOT_ANCHORS rows
    }

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = np.array(sorted(hot), dtype=np.int64)
        sides = np.array([hot[k] for k in keys.tolist()], dtype=np.int64)
        for part in batches:
            everything = part["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(everything), 1024):
                fps = everything[at : at + 1024]
                rows, anchor, home = anchors_of(fps, dimension, threshold, width)
                side = np.ones(len(rows), dtype=np.int64)
                if len(keys):
                    where = np.minimum(np.searchsorted(keys, anchor), len(keys) - 1)
                    side = np.where(keys[where] == anchor, sides[where], 1)
                # as a member: own column of cells; as a home: own row of cells too
                chunk = (_mix(fps[rows]) % side.astype(np.uint64)).astype(np.int64)
                made = []
                for as_home in (False, True):
                    pick = home if as_home else np.ones(len(rows), dtype=bool)
                    times = side[pick]
                    i = np.repeat(np.nonzero(pick)[0], times)
                    j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                    cells = chunk[i] * side[i] + j if as_home else j * side[i] + chunk[i]
                    made.append(pd.DataFrame({
                        "anchor": anchor[i], "cell": cells.astype(np.int32),
                        "fp": fps[rows[i]].view(np.int64), "home": as_home,
                    }))
                yield pd.concat(made)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        home = part["home"].to_numpy(bool)
        fps = part["fp"].to_numpy(np.int64).view(np.uint64)
        own = np.unique(fps[home])
        every = np.unique(fps)
        found = spanning_links(every, np.isin(every, own), threshold)
        pairs = every.view(np.int64)[np.array(found, dtype=np.int64).reshape(-1, 2)]
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return (
        nodes.select("fp").mapInPandas(visits, "anchor long, cell int, fp long, home boolean")
        .groupBy("anchor", "cell").applyInPandas(compare, "u long, v long")
    )


def grouped(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, same, fp, component, component_id) of every row of ``docs``.

    ``component`` is the smallest fingerprint of the row's group.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    rows = stored(fingerprints(docs, shingle).select("*", salt), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    count = nodes.count()
    named = nodes.select("fp", "first", F.col("fp").alias("component"))
    if count > 1:
        groups = connected_components(links(nodes, count, threshold)).withColumnRenamed("node", "fp")
        named = stored(
            nodes.join(groups, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "named"
        )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    # a fingerprint, or a group, may be that of most rows: copies of one text, or empty ones
    found = named.select("fp", "component", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    found = spread_join(found, least, "component").select("fp", "component", "component_id")
    return spread_join(rows, found, "fp").drop("salt")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id): groups of documents linked by their fingerprints.

    component_id is the smallest doc_id reachable over links of at most
    ``threshold`` differing bits. One row per input row: repeated rows and equal
    texts share a fingerprint and so a group; texts that are null or without a
    word have fingerprint zero and are linked like any other. A null doc_id
    keeps its row; component_id is null only if its whole group has no id. An
    empty table gives an empty result. Only doc_id and text are read.
    """
    return grouped(docs, shingle, threshold).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near duplicates, unchanged; see keep_first."""
    return keep_first(docs, grouped(docs, shingle, threshold))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``component`` of ``groups`` (doc_id, same, component), unchanged.

    A group keeps one row: that of its smallest doc_id, null last; of rows that
    share it the one with the smallest hash of the text; of those the one with
    the smallest hash of the row. Columns of ``docs``, of any types and names,
    pass through. Rows of one id and text are cut to one before they travel.
    """
    keys = [F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), F.col("same").alias("k_same")]
    kept = (
        groups.groupBy("component")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("best"))
        .select("best.doc_id", "best.same").select(*keys)
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("same"), row_hash(docs).alias("turn"))
    rows = rows.select("row", "turn", *keys).groupBy("k_id", "k_null", "k_same").agg(F.min_by("row", "turn").alias("row"))
    return rows.join(kept, ["k_id", "k_null", "k_same"], "left_semi").select("row.*")
