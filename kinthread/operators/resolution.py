"""Resolution: which tracker takes which record."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinthread.operators.components import components
from kinthread.operators.scoring import rank_records
from kinthread.runtime import stored

#: Interesting pairs up to which the greedy matching runs on the driver.
DRIVER_PAIRS = 200_000
#: Pairs of components that a task settles as a whole.
TOGETHER = 500_000
#: A round that settles or drops a smaller share of the pairs is followed by one over components.
LEAST_SETTLED = 0.1

#: Thresholds of ``best_match_by_steps``; pairs that meet at the last at once.
STEPS, AT_ONCE = (0.8, 0.65, 0.55, 0.48), 1 << 22
#: What a matching looks at.
PAIR = ("tracker_id", "record_idx", "score", "tie")


def simple(scores: DataFrame) -> DataFrame:
    """(tracker_id, record_idx, score): each tracker's best record; records may be taken twice."""
    return rank_records(scores).where("record_rank = 1").select("tracker_id", "record_idx", "score")


def greedy(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """One-to-one matching of (tracker, record, score): best score first, then as ``tie`` has it, smaller tracker, record."""
    trackers, records, out = set(), set(), []
    for t, r, s in sorted(pairs, key=lambda p: (-p[2], -tie_of(p[0], p[1]), p[0], p[1])):
        if t not in trackers and r not in records:
            trackers.add(t)
            records.add(r)
            out.append((t, r, s))
    return out


def tie_of(tracker_id: int, record_idx: int) -> int:
    return int(hashlib.md5(f"{tracker_id}:{record_idx}".encode()).hexdigest()[:12], 16)


def mutual_best(scores: DataFrame, together: int | None = None) -> DataFrame:
    """A greedy matching of any number of pairs: ``greedy`` in the order (score, ``tie``, tracker, record).

    A round settles the pairs that are best for both sides; their trackers and
    records go. Equal scores are ordered by a seeded hash of the pair, so that a
    block of them takes few rounds. Where a round settles few, as on a path of
    rising scores, what is left is cut into connected components: those of up to
    ``together`` pairs (TOGETHER) are settled as a whole, many in a task; of
    larger ones the better half of the pairs comes first, by itself, which is
    what the order does anyway. Rounds are stored, so lineage stays short. A
    column ``tie`` of ``scores`` is taken instead of the hash.
    """
    together = TOGETHER if together is None else together
    left = scores.select("tracker_id", "record_idx", "score", F.col("tie") if "tie" in scores.columns else tie(F.col("tracker_id"), F.col("record_idx")).alias("tie"))
    return _matched(stored(left, "pairs"), together)


def _matched(left: DataFrame, together: int) -> DataFrame:
    place = F.struct("score", "tie", (-F.col("tracker_id")).alias("t"), (-F.col("record_idx")).alias("r"))
    done = left.limit(0).drop("tie")
    count = left.count()
    while count:
        by_tracker = left.groupBy("tracker_id").agg(F.max(place).alias("best")).select(F.struct("tracker_id", (-F.col("best.r")).alias("record_idx")).alias("pair"), "best.score")
        by_record = left.groupBy("record_idx").agg(F.max(place).alias("best")).select(F.struct((-F.col("best.t")).alias("tracker_id"), "record_idx").alias("pair"))
        won = stored(by_tracker.join(by_record, "pair", "left_semi").select("pair.tracker_id", "pair.record_idx", "score"), "won")
        done = done.union(won)
        left = stored(_without(left, won), "pairs")
        before, count = count, left.count()
        if count and count > before * (1 - LEAST_SETTLED):
            won, left = _by_components(left, together)
            done = done.union(won)
            count = left.count()
    return done


def _without(pairs: DataFrame, won: DataFrame) -> DataFrame:
    """``pairs`` whose tracker and record are both still free."""
    return pairs.join(won.select("tracker_id"), "tracker_id", "left_anti").join(won.select("record_idx"), "record_idx", "left_anti").select(*pairs.columns)


def _by_components(left: DataFrame, together: int) -> tuple[DataFrame, DataFrame]:
    """(matches, pairs still open): small components settled, and the better half of the pairs of large ones."""
    # two nodes of one hash would only make one component of two
    node = F.xxhash64(F.lit("tracker"), "tracker_id")
    nodes = stored(components(left.select(node.alias("u"), F.xxhash64(F.lit("record"), "record_idx").alias("v"))), "components")
    placed = stored(left.withColumn("node", node).join(nodes, "node").drop("node"), "placed")
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > together).select("component"), "large")
    small = placed.join(large, "component", "left_anti")
    buckets = max(1, -(-left.count() // together))
    won = stored(
        small.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
        .groupBy("bucket").applyInArrow(_settled, "tracker_id long, record_idx long, score float"), "won",
    )
    rest = stored(placed.join(large, "component").select(*left.columns), "pairs")
    better = _better_half(rest)
    if better is None:
        return won, rest
    first = stored(_matched(stored(better, "better"), together), "won")
    return won.union(first), stored(_without(rest, first), "pairs")


def _better_half(pairs: DataFrame) -> DataFrame | None:
    """About half of the pairs, none worse than any of the others; None if they can't be told apart."""
    for column in ("score", "tie"):
        low, middle, high = pairs.agg(F.min(column), F.percentile_approx(column, 0.5), F.max(column)).first()
        if low is None:
            return None
        if low < high:
            # only pairs of one score are told apart by their ties
            return pairs.where(F.col(column) > middle if middle < high else F.col(column) >= middle)
    return None


def _settled(table: pa.Table) -> pa.Table:
    """The greedy matching of whole components."""
    columns = {c: table[c].to_numpy() for c in ("tracker_id", "record_idx", "score", "tie")}
    order = np.lexsort((columns["record_idx"], columns["tracker_id"], -columns["tie"], -columns["score"]))
    trackers, records, kept = set(), set(), []
    for i, t, r in zip(order.tolist(), columns["tracker_id"][order].tolist(), columns["record_idx"][order].tolist(), strict=True):
        if t not in trackers and r not in records:
            trackers.add(t)
            records.add(r)
            kept.append(i)
    return table.select(["tracker_id", "record_idx", "score"]).take(pa.array(kept, pa.int64()))


def tie(tracker_id: Column, record_idx: Column) -> Column:
    """What orders pairs of equal scores, largest first: pseudo-random, so that neither side's order is that of the other's."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", tracker_id.cast("string"), record_idx.cast("string"))), 1, 12), 16, 10).cast("long")


def best_match(scores: DataFrame, driver_pairs: int = DRIVER_PAIRS) -> DataFrame:
    """(tracker_id, record_idx, score): the stable one-to-one matching.

    Few pairs, checked first, are matched on the driver in one sort; more by
    ``mutual_best``. Both give the greedy matching in the order (score
    descending, tie descending, tracker, record).
    """
    pairs = scores.select("tracker_id", "record_idx", "score")
    found = pairs.limit(driver_pairs + 1).collect()
    if len(found) > driver_pairs:
        return mutual_best(pairs)
    return scores.sparkSession.createDataFrame(
        greedy([tuple(r) for r in found]), "tracker_id long, record_idx long, score float"
    )


def best_match_by_steps(
    trackers: DataFrame, records: DataFrame, scores_over: Callable[[DataFrame, DataFrame, float | None], DataFrame], steps: Sequence[float] = STEPS,
    match: Callable[[DataFrame], DataFrame] = best_match,
) -> DataFrame:
    """``best_match`` of what ``scores_over`` (trackers, records, a threshold) gives for None, without making all of these scores.

    The matching takes better pairs first, so those over a higher threshold are
    settled by themselves, and trackers and records that they take have no use
    for others. What is free meets again at the next of ``steps`` (falling), at
    last at None; few pairs go there at once. Given a threshold,
    ``scores_over`` must give exactly the pairs that score over it. ``match``
    is how the pairs of a step are matched.
    """
    done, left = None, [*steps, None]
    trackers, records = stored(trackers, "free"), stored(records, "free")
    while left:
        n = trackers.count() * records.count()
        left = left[-1:] if n <= AT_ONCE else left
        scores = scores_over(trackers, records, left.pop(0))
        won = stored(match(stored(scores.select(*(c for c in PAIR if c in scores.columns)), "scores")), "won")
        done = won if done is None else done.union(won)
        if left:
            trackers, records = stored(unmatched_trackers(trackers, won), "free"), stored(unmatched_records(records, won), "free")
    return done


def resolve(scores: DataFrame, strategy: str) -> DataFrame:
    return simple(scores) if strategy == "simple" else best_match(scores)


def unmatched_records(records: DataFrame, matches: DataFrame) -> DataFrame:
    """Records that no tracker took: each begins a tracker."""
    return records.join(matches.select("record_idx"), "record_idx", "left_anti")


def unmatched_trackers(trackers: DataFrame, matches: DataFrame) -> DataFrame:
    return trackers.join(matches.select("tracker_id"), "tracker_id", "left_anti")


def is_alive(limit_no_match_streak: int) -> Column:
    """Whether a tracker has missed no more frames in a row than the limit."""
    return F.col("streak") <= limit_no_match_streak


def alive(trackers: DataFrame, limit_no_match_streak: int) -> DataFrame:
    """Trackers that live on."""
    return trackers.where(is_alive(limit_no_match_streak))


def final_streaks(chain_nodes: DataFrame) -> DataFrame:
    """(tracker_id, streak): frames that each chain has missed up to the last frame of all."""
    ends = chain_nodes.groupBy("tracker_id").agg(F.max("frame_idx").alias("last"))
    top = chain_nodes.agg(F.max("frame_idx").alias("top"))  # one row
    return ends.crossJoin(F.broadcast(top)).select("tracker_id", (F.col("top") - F.col("last")).cast("int").alias("streak"))


def missed_before(chain_nodes: DataFrame) -> DataFrame:
    """(tracker_id, frame_idx, missed): frames missed between each node and the one before."""
    before = F.lag("frame_idx").over(Window.partitionBy("tracker_id").orderBy("frame_idx"))
    return chain_nodes.select("tracker_id", "frame_idx", F.coalesce(F.col("frame_idx") - before - 1, F.lit(0)).cast("int").alias("missed"))
