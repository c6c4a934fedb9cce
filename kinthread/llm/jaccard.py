"""SimHash near duplicates made complete for a Jaccard similarity of word shingles.

Sets of shingles are fingerprinted and linked by the anchor-point covering of
``simhash``; every link is confirmed by the exact similarity of the two sets.
Sets may be as similar as wanted and yet differ in more bits than the covering
finds, so what isn't in one group by then is completed by a prefix join. Order
all shingles alike in every set, frequent ones last. If two sets of n and m
shingles have J >= t, they share at least t / (1 + t) (n + m), so the first one
that both have stands early: at positions p and q (from 0) with
min(n - p, m - q) >= t / (1 + t) (n + m). Only the first n - ceil(t n) + 1
shingles of a set can stand so early. Pairs that meet there
and are near by their fingerprints (MOST_BITS) are compared exactly. The order
only decides how many pairs meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinthread.llm.common import SALTS, connected_components, give_back, spread_join, stored
from kinthread.llm.simhash import SEED, Forest, _runs, bit_counts, keep_first, majority
from kinthread.llm.simhash import links as anchored_links

SHINGLE = 5
#: Least similarity of near duplicates, as a fraction: exact in whole numbers.
OVER, UNDER = 4, 5
#: Buckets that the shingles of all texts are counted in, to know the frequent ones: more would only spare comparisons.
FREQUENT = 1 << 22
#: Buckets whose counts travel as one row.
BLOCK = 1 << 14
#: Texts to compare are picked by a broadcast of their hashes up to this number, counted first.
BROADCAST_ROWS = 200_000
#: Words whose hash a worker remembers; more would only spare hashing.
WORDS = 1 << 16
#: Sets that a worker remembers to have given out; more would only spare rows.
SEEN = 1 << 20
#: Tokens of several sets that are told to the workers (8 bytes each), counted first.
KNOWN = 2_000_000
#: Bits of their SimHash that sets of the least similarity differ in, at most: expected are 10 of 64, more than this
#: once in some ten million pairs.
MOST_BITS = 26
#: Sets of fewer shingles are compared whatever their fingerprints.
FEW = 16
#: A position's bits beside a set's size in one number.
PLACE = 32
#: Longs of a set's parities: more would only spare comparisons of large sets.
PARITIES = 8
PARITY = [f"s{i}" for i in range(PARITIES)]
#: A token's centre is picked by the share of a set that stands before the token, of so many bits, and by last bits of node.
SHARE, NAME = 20, 42
#: Sets of a token up to which all its pairs may meet at once. Of more only nearest ones meet first: of each set's first
#: LOOKS such tokens, among CHUNK of its sets. More would only spare comparisons later.
CROWD, LOOKS, CHUNK = 32, 5, 64


class _Hashes(dict):
    """Hash of every word met, of up to WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_HASHES = _Hashes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, one without a word none."""
    hashes = [
        np.fromiter(map(_HASHES.__getitem__, run), dtype=np.uint64, count=len(run))
        for run in _runs((text or "").encode("utf-8", "surrogatepass").lower())
    ]
    words = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = (total ^ words[i : i + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least OVER / UNDER."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * common >= OVER * (len(a) + len(b) - common)


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set by which others find it, in order: those of the least counted buckets first."""
    n = len(found)
    found = found[np.lexsort((found, counts[bucket_of(found, len(counts))]))]
    return found[: n - (OVER * n + UNDER - 1) // UNDER + 1]


def bucket_of(found: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that each shingle is counted in."""
    return (found % np.uint64(buckets)).astype(np.int64)


def among(found: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``found`` are in the sorted ``known``: by search, since a set is small and ``known`` is not."""
    if not len(known):
        return np.zeros(len(found), dtype=bool)
    return known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many texts of ``docs``, all of them, have each of the FREQUENT buckets' shingles (one of several counts each).

    A task's counts are arrays, compressed blocks of which are added up, so what
    travels doesn't grow with the shingles of a task.
    """
    buckets = FREQUENT

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        total = np.zeros(buckets, dtype=np.uint32)
        for part in batches:
            for text in part["text"]:
                np.add.at(total, bucket_of(shingles(text), buckets), 1)
        for at in range(0, buckets, BLOCK):
            mine = total[at : at + BLOCK]
            if mine.any():
                yield _block(at, mine)
        del total, mine
        give_back()

    def added(part: pd.DataFrame) -> pd.DataFrame:
        return _block(int(part["at"].iloc[0]), sum(map(_counts_of, part["counts"], part["width"])))

    total = np.zeros(buckets, dtype=np.int64)
    made = docs.select("text").mapInPandas(of_texts, "at long, width int, counts binary")
    for row in made.groupBy("at").applyInPandas(added, "at long, width int, counts binary").collect():
        mine = _counts_of(row["counts"], row["width"])
        total[row["at"] : row["at"] + len(mine)] = mine
    return _narrow(total)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """``counts`` in as few bytes as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max())))


def _block(at: int, counts: np.ndarray) -> pd.DataFrame:
    """A row of counts from bucket ``at`` on."""
    narrow = _narrow(counts)
    return pd.DataFrame({"at": [at], "width": np.array([narrow.itemsize], dtype=np.int32), "counts": [zlib.compress(narrow.tobytes(), 1)]})


def _counts_of(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=f"u{width}").astype(np.int64)


def node_of(found: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def fingerprint_of(found: np.ndarray) -> int:
    """SimHash of a set of shingles' hashes; zero for none."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 8192):
        total += bit_counts(found[at : at + 8192])
    return majority(total, len(found))


def parities_of(found: np.ndarray) -> np.ndarray:
    """PARITIES longs: whether each of their bits' share of all hashes holds an odd number of the set's.

    A hash that one of two sets has and the other hasn't turns one bit, so sets
    differ in at least as many hashes as bits.
    """
    odd = np.bincount((found >> np.uint64(32)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, same, node, fp, parities): one row per row; node names the text's set of shingles, fp is its SimHash."""
    columns = ["node", "fp", *PARITY]

    @F.pandas_udf(", ".join(f"{name} long" for name in columns))
    def of_text(text: pd.Series) -> pd.DataFrame:
        made = [np.array([node_of(x), fingerprint_of(x), *parities_of(x).tolist()], dtype=np.uint64) for x in map(shingles, text)]
        return pd.DataFrame(np.array(made, dtype=np.uint64).reshape(-1, len(columns)).view(np.int64), columns=columns)

    return docs.select("doc_id", F.xxhash64("text").alias("same"), of_text("text").alias("e")).select("doc_id", "same", "e.*")


def prefixes(docs: DataFrame, counts: np.ndarray, known: np.ndarray | None = None, brief: bool = False) -> DataFrame:
    """(token, node, place, fp): the prefix of every set, with its size and the position in one number, and its SimHash.

    ``known`` are the only tokens to give out, if not None. ``brief`` gives
    (token, mark) instead, mark being the last bits of node.
    """
    shared = docs.sparkSession.sparkContext.broadcast((counts, known))

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        counts, known = shared.value
        held, rows, seen = [], 0, set()

        def frame() -> pd.DataFrame:
            sizes = [len(first) for first, *_ in held]
            token = np.concatenate([first for first, *_ in held]).view(np.int64)
            node = np.repeat(np.array([node for _, _, node, _, _ in held], dtype=np.uint64).view(np.int64), sizes)
            if brief:
                return pd.DataFrame({"token": token, "mark": node.astype(np.int32)})
            return pd.DataFrame({
                "token": token, "node": node,
                "place": np.repeat(np.array([n << PLACE for *_, n, _ in held], dtype=np.int64), sizes) + np.concatenate([at for _, at, *_ in held]),
                "fp": np.repeat(np.array([fp for *_, fp in held], dtype=np.uint64).view(np.int64), sizes),
            })

        for part in batches:
            for text in part["text"]:
                found = shingles(text)
                node = node_of(found)
                if node in seen or not len(found):
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                first = prefix(found, counts)
                at = np.arange(len(first))
                if known is not None:
                    mine = among(first, known)
                    first, at = first[mine], at[mine]
                if not len(first):
                    continue
                held.append((first, at, node, len(found), 0 if brief else fingerprint_of(found)))
                rows += len(first)
                if rows >= 1 << 16:
                    yield frame()
                    held, rows = [], 0
        if held:
            yield frame()
        held.clear()
        seen.clear()
        give_back()

    return docs.select("text").mapInPandas(of_texts, "token long, mark int" if brief else "token long, node long, place long, fp long")


def collected(tokens: DataFrame) -> np.ndarray:
    """The ``tokens``, sorted, on the driver: sent as rows of many, since a row each is an object each there."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"tokens": [part["token"].to_numpy(np.int64).tobytes()]})

    rows = tokens.select("token").mapInPandas(packed, "tokens binary").collect()
    return np.sort(np.frombuffer(b"".join(row["tokens"] for row in rows), dtype=np.uint64))


def entries(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, node, place, fp) of the tokens in the prefixes of several sets.

    Most tokens are of one set. What tells which aren't is a brief row a token.
    Up to KNOWN of those, counted, are told to the workers, so that only their
    rows ever travel; of more all rows do, and the others are dropped then.
    """
    marks = prefixes(docs, counts, brief=True)
    several = stored(
        marks.groupBy("token").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a <> b").select("token"), "tokens"
    )
    known = None
    if several.count() <= KNOWN:
        known = collected(several)
    every = stored(prefixes(docs, counts, known), "prefixes")
    if known is None:
        every = every.join(several, "token")
    shared = every.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("token")
    return stored(every.join(shared, "token").distinct(), "shared")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts are alike, by their whole sets."""
    pairs = stored(pairs.distinct(), "pairs")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = stored(rows.groupBy("node").agg(F.min("same").alias("same")).join(nodes, "node", "left_semi"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    # copies of a text are cut to one where they are read
    texts = stored(
        docs.select(F.xxhash64("text").alias("same"), "text").join(F.broadcast(wanted) if few else wanted, "same")
        .groupBy("node").agg(F.first("text").alias("text")),
        "texts",
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            last, own = None, None
            keep = np.zeros(len(part), dtype=bool)
            for i, (u, a, b) in enumerate(zip(part["u"], part["a"], part["b"], strict=True)):
                if u != last:
                    last, own = u, shingles(a)
                keep[i] = alike(own, shingles(b))
            yield part.loc[keep, ["u", "v"]]
        give_back()

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return stored(both.select("u", "v", "a", "b").mapInPandas(compare, "u long, v long"), "alike")


def anchored(rows: DataFrame) -> DataFrame:
    """(u, v): sets to compare that the anchor-point covering links, and those of equal fingerprints."""
    nodes = stored(rows.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "nodes")
    count = nodes.count()
    several = nodes.where("first <> last").select("fp", "first")
    pairs = rows.select("fp", "node").distinct().join(several, "fp").where("node <> first").select(
        F.col("first").alias("u"), F.col("node").alias("v")
    )
    if count > 1:
        near = anchored_links(nodes, count)
        one, two = (nodes.select(F.col("fp").alias(k), F.col("first").alias(f"node_{k}")) for k in ("u", "v"))
        pairs = pairs.union(near.join(one, "u").join(two, "v").select("node_u", "node_v"))
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def nearest(part: np.ndarray, n: np.ndarray, fp: np.ndarray, parities: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (positions) of sets that may be alike, spanning the parts that such pairs connect, the nearest first.

    Never more pairs than sets.
    """
    differ = sum(np.bitwise_count(mine[:, None] ^ mine[None, :]).astype(np.int64) for mine in parities.T)
    apart = np.bitwise_count(fp[:, None] ^ fp[None, :]).astype(np.int64)
    least, most = np.minimum.outer(n, n), np.maximum.outer(n, n)
    may = ((least < FEW) | (apart <= MOST_BITS)) & (least * UNDER >= most * OVER)
    may &= differ * (OVER + UNDER) <= (least + most) * (UNDER - OVER)
    far = np.iinfo(np.int64).max
    bits = np.where(may, differ + apart, far)
    forest, out = Forest(len(part)), []
    _, first, label = np.unique(part, return_index=True, return_inverse=True)
    for i, x in enumerate(first[label].tolist()):
        forest.link(i, x)
    while True:
        label = np.array([forest.root(i) for i in range(len(part))])
        bits[label[:, None] == label[None, :]] = far
        other = bits.argmin(axis=1)
        own = bits[np.arange(len(part)), other]
        if (own == far).all():
            return out
        for i in np.argsort(own, kind="stable")[: (own < far).sum()].tolist():
            if forest.link(i, int(other[i])):
                out.append((i, int(other[i])))


def crowds(rest: DataFrame) -> DataFrame:
    """(u, v): near pairs of different parts among the sets of tokens that more than CROWD have; a few for each set.

    It finds no pair that the last comparison wouldn't, and need not find all.
    """

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        parities = np.column_stack([part[name].to_numpy(np.int64).view(np.uint64) for name in PARITY])
        fp = part["fp"].to_numpy(np.int64).view(np.uint64)
        found = nearest(part["part"].to_numpy(np.int64), part["n"].to_numpy(np.int64), fp, parities)
        pairs = np.sort(part["node"].to_numpy(np.int64)[np.array(found, dtype=np.int64).reshape(-1, 2)], axis=1)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    own = ["part", "n", "fp", *PARITY]
    looks = F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("token").alias("turn"), "token", "many"))), 1, LOOKS)
    sets = rest.where(F.col("many") > CROWD).groupBy("node").agg(looks.alias("looks"), *(F.min(name).alias(name) for name in own))
    rows = sets.withColumn("look", F.explode("looks")).select("node", *own, "look.token", "look.many")
    rows = rows.withColumn("chunk", F.expr(f"pmod(xxhash64(node, token), many div {CHUNK} + 1)")).drop("many")
    return rows.groupBy("token", "chunk").applyInPandas(compare, "u long, v long")


def parts_of(links: DataFrame) -> DataFrame:
    """(node, part): the groups that ``links`` make."""
    return connected_components(links).select("node", F.col("component").alias("part"))


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v) links between sets that span every group.

    First the pairs that the covering links. Then each set meets the centre of
    those that share a shingle of its prefix, if that isn't in its group: the set
    that has the least of itself before the shingle, which of changed copies is
    the one with the fewest changes. Then, where many share a shingle, some of
    the nearest ones of different groups meet. Last, all sets that still are in
    different groups meet each other. So a large group of near copies gives
    trees, not its pairs. Whatever meets must be near enough by sizes,
    fingerprints and parities, and by positions where all meet.
    """
    found = verified(anchored(rows), docs, rows)
    shared = entries(docs, bucket_counts(docs))
    parities = stored(rows.groupBy("node").agg(*(F.min(name).alias(name) for name in PARITY)), "parities")
    differ = " + ".join(f"bit_count(x.{name} ^ y.{name})" for name in PARITY)
    near = " AND ".join([
        "x.token = y.token AND x.part <> y.part",
        f"(least(x.n, y.n) < {FEW} OR bit_count(x.fp ^ y.fp) <= {MOST_BITS})",
        f"least(x.n, y.n) * {UNDER}L >= greatest(x.n, y.n) * {OVER}L",
        f"least(x.n - x.at, y.n - y.at) * {OVER + UNDER}L >= (x.n + y.n) * {OVER}L",
        f"({differ}) * {OVER + UNDER}L <= (x.n + y.n) * {UNDER - OVER}L",
    ])

    def parted(table: DataFrame) -> DataFrame:
        """``table`` with n, at, rank, parities and the part of each set so far, centre being a token's least rank and many its sets; only tokens of several parts."""
        table = table.select("token", "node", "fp", F.expr(f"shiftright(place, {PLACE})").alias("n"), F.expr(f"place & {(1 << PLACE) - 1}L").alias("at"))
        table = table.withColumn("rank", F.expr(f"shiftleft(at * {1 << SHARE}L div n, {NAME}) | (node & {(1 << NAME) - 1}L)"))
        table = table.join(parts_of(found), "node", "left").withColumn("part", F.coalesce("part", "node"))
        several = table.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min("rank").alias("centre"), F.count(F.lit(1)).alias("many")).where("a <> b").drop("a", "b")
        return stored(table.join(several, "token").join(parities, "node"), "parts")

    def met(x: DataFrame, y: DataFrame, such: str) -> DataFrame:
        pairs = x.alias("x").join(y.alias("y"), F.expr(f"{such} AND {near}"))
        return pairs.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))

    rest = parted(shared)
    found = found.union(verified(met(rest.where("rank = centre"), rest, "x.node <> y.node"), docs, rows))
    rest = parted(shared)
    more = verified(crowds(rest), docs, rows)
    if not more.isEmpty():
        found = found.union(more)
        rest = parted(shared)
    return found.union(verified(met(rest, rest, "x.node < y.node"), docs, rows))


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, same, node, component) of every row: component is the smallest set reachable over links.

    Texts without a word have one set, the empty one, and are a group.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    rows = stored(sets(docs).select("*", salt), "sets")
    groups = parts_of(stored(links(docs, rows), "links"))
    return spread_join(rows.drop(*PARITY), groups, "node", "left").select("doc_id", "same", "node", F.coalesce("part", "node").alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near duplicates, unchanged; see simhash.keep_first.

    A group is what links of a Jaccard similarity of 0.8 or more reach, over
    sets of five-word shingles of whole texts (fewer words: all of them). Null
    texts, empty ones and those without a word are one group. A group keeps its
    smallest doc_id, null last; of rows that share it, one by their hash. Columns
    of any names and types stay; no rows give none.
    """
    return keep_first(docs, grouped(docs))
