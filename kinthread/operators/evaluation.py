"""Evaluation of chains: lengths, ratios, histograms, consistency.

Where a function takes ``by``, these are columns of its tables that tell runs
apart: each run is evaluated by itself, in the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinthread.functions.similarity import character_table, native_levenshtein
from kinthread.functions.tables import Texts

from kinthread.operators.graph import with_positions
from kinthread.runtime import stored


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """``left`` with the one row of ``right`` for its run."""
    return left.join(F.broadcast(right), list(by), "left") if by else left.crossJoin(F.broadcast(right))


def chain_lengths(chain_nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, tracker_id, length, lifespan)."""
    return chain_nodes.groupBy(*by, "tracker_id").agg(
        F.count(F.lit(1)).alias("length"), (F.max("frame_idx") - F.min("frame_idx") + 1).alias("lifespan")
    )


def length_statistics(chain_nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (by, average, median, max, min, histogram of lengths 0..max) a run; without ``by`` zeros and [] for no chain.

    The median of an even number of chains is the whole part of the middle two's mean.
    """
    lengths = chain_lengths(chain_nodes, by)
    by_length = lengths.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("n"))
    one = by_length.groupBy(*by).agg(
        F.sum(F.col("length") * F.col("n")).alias("total"), F.sum("n").alias("chains"),
        F.max("length").alias("max"), F.min("length").alias("min"),
        F.map_from_entries(F.collect_list(F.struct("length", "n"))).alias("counts"),
    )
    middle = lengths.groupBy(*by).agg(F.percentile("length", 0.5).alias("middle"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), "max"), lambda i: F.coalesce(F.col("counts")[i], F.lit(0).cast("long")))
    return _beside(one, middle, by).select(
        *by, F.coalesce(F.col("total") / F.col("chains"), F.lit(0.0)).cast("float").alias("average"),
        F.coalesce(F.floor("middle"), F.lit(0)).cast("long").alias("median"),
        F.coalesce("max", F.lit(0)).cast("long").alias("max"), F.coalesce("min", F.lit(0)).cast("long").alias("min"),
        F.coalesce(F.when(F.col("max").isNotNull(), dense), F.array().cast("array<bigint>")).alias("histogram"),
    )


def _ratio(part, whole):
    """part / whole, NaN for 0 / 0."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(part / whole).cast("float")


def graph_properties(chain_nodes: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, frame_idx, records_match_ratio, trackers_match_ratio, conflict_ratio) per frame.

    Nodes with an edge in over all nodes; trackers that come in and go out of
    frame's nodes over those that go out (NaN in the last frame); nodes with
    several edges in over all nodes.
    """
    frame, placed = [*by, "frame_idx"], with_positions(chain_nodes, by)
    into = placed.where("comes_in").groupBy(*frame, "record_idx").agg(F.count(F.lit(1)).alias("n"))
    per_node = nodes.join(into, [*frame, "record_idx"], "left").groupBy(*frame).agg(
        F.count(F.lit(1)).alias("nodes"), F.count("n").alias("matched"), F.count(F.when(F.col("n") > 1, 1)).alias("conflicts")
    )
    per_chain = placed.groupBy(*frame).agg(F.count_if("goes_out").alias("out"), F.count_if(F.col("goes_out") & F.col("comes_in")).alias("both"))
    joined = per_node.join(per_chain, frame, "left").fillna(0, ["out", "both"])
    return joined.select(
        *frame, _ratio(F.col("matched"), F.col("nodes")).alias("records_match_ratio"),
        _ratio(F.col("both"), F.col("out")).alias("trackers_match_ratio"),
        _ratio(F.col("conflicts"), F.col("nodes")).alias("conflict_ratio"),
    )


def average_match_ratios(properties: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a run: mean record ratio without the first frame, mean tracker ratio without first and last."""
    low, high = F.min("frame_idx"), F.max("frame_idx")
    ends = properties.groupBy(*by).agg(low.alias("low"), high.alias("high"))
    inner = _beside(properties, ends, by).where(F.col("frame_idx") > F.col("low"))
    return inner.groupBy(*by).agg(
        F.avg(F.col("records_match_ratio").cast("double")).alias("records_match_ratio"),
        F.avg(F.when(F.col("frame_idx") < F.col("high"), F.col("trackers_match_ratio").cast("double"))).alias("trackers_match_ratio"),
    )


def start_end_frames(chain_nodes: DataFrame, frames: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, frame_idx, starts, ends) for all ``frames``."""
    ends = chain_nodes.groupBy(*by, "tracker_id").agg(F.min("frame_idx").alias("s"), F.max("frame_idx").alias("e"))
    starts = ends.groupBy(*by, F.col("s").alias("frame_idx")).agg(F.count(F.lit(1)).alias("starts"))
    stops = ends.groupBy(*by, F.col("e").alias("frame_idx")).agg(F.count(F.lit(1)).alias("ends"))
    every = chain_nodes.sparkSession.range(frames).select(F.col("id").cast("int").alias("frame_idx"))
    if by:
        every = chain_nodes.select(*by).distinct().crossJoin(F.broadcast(every))  # a row a run and frame, as in the result
    key = [*by, "frame_idx"]
    return every.join(starts, key, "left").join(stops, key, "left").fillna(0, ["starts", "ends"])


def match_histograms(scores: DataFrame, trackers: DataFrame, records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, kind, value, n): how many records (trackers) have so many interested trackers (interesting records), 0 too.

    ``by`` are columns of all three tables whose values are looked at each by itself.
    """
    sides = []
    for kind, key, table in (("record", "record_idx", records), ("tracker", "tracker_id", trackers)):
        counts = scores.groupBy(*by, key).agg(F.count(F.lit(1)).alias("value"))
        sides.append(table.select(*by, key).join(counts, [*by, key], "left").select(*by, F.lit(kind).alias("kind"), F.coalesce("value", F.lit(0).cast("long")).alias("value")))
    return sides[0].union(sides[1]).groupBy(*by, "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def dense_histogram(counts: DataFrame, value: str = "value", n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """One row (by, histogram array<bigint>) a run of (by, value, n) rows, index 0..max."""
    one = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(value, n))).alias("m"), F.max(value).alias("top"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long")), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long")))
    return one.select(*by, F.coalesce(F.when(F.col("top").isNotNull(), dense), F.array().cast("array<bigint>")).alias("histogram"))


def merge_histograms(histograms: DataFrame, column: str = "histogram") -> DataFrame:
    """(value, n): the element-wise sum of ragged histograms."""
    return histograms.select(F.posexplode(column).alias("value", "n")).groupBy("value").agg(F.sum("n").alias("n"))


def histogram_mean_median(counts: DataFrame) -> DataFrame:
    """One row (mean, median) of (value, n) rows; the median is the lower middle."""
    order = Window.orderBy("value")  # one row a distinct value
    total = counts.agg(F.sum("n").alias("total"))
    run = counts.withColumn("until", F.sum("n").over(order)).crossJoin(F.broadcast(total))
    middle = F.min(F.when(F.col("until") * 2 >= F.col("total"), F.col("value")))
    return run.agg((F.sum(F.col("value") * F.col("n")) / F.max("total")).alias("mean"), middle.cast("long").alias("median"))


def divergence_and_conflict(counts: DataFrame) -> DataFrame:
    """One row (divergence, conflict): shares over one of those over none, of trackers and of records.

    ``counts`` as from match_histograms.
    """
    def share(kind: str):
        mine = (F.col("kind") == kind) & (F.col("value") >= 1)
        some = F.sum(F.when(mine, F.col("n")))
        return F.sum(F.when(mine & (F.col("value") >= 2), F.col("n")).otherwise(F.when(mine, 0))) / some

    return counts.agg(share("tracker").alias("divergence"), share("record").alias("conflict"))


def tail_counts(chain_nodes: DataFrame, tails: tuple[int, ...] = (2, 5, 10, 20)) -> DataFrame:
    """One row: chains of at least so many nodes."""
    lengths = chain_lengths(chain_nodes)
    return lengths.agg(*(F.count_if(F.col("length") >= t).alias(f"at_least_{t}") for t in tails))


def consistency(values: DataFrame, column: str = "value", strict: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(by, tracker_id, consistency): mean similarity of successive values of a chain, 0 for none.

    1 - edit distance over the longer's characters; null is "", two empty
    values don't count. ``strict`` takes values as they are and divides by the
    pairs (null where a value is).
    """
    here, before = F.col("here"), F.col("before")
    value = F.col(column) if strict else F.coalesce(F.col(column), F.lit(""))
    size = F.greatest(F.length(here), F.length(before))
    like = F.when(size == 0, F.lit(float("nan")) if strict else None).otherwise(1 - F.levenshtein(before, here) / size)
    order = Window.partitionBy(*by, "tracker_id").orderBy("frame_idx")
    pairs = values.select(*by, "tracker_id", "frame_idx", value.alias("here")).withColumn("before", F.lag("here").over(order))
    first = F.row_number().over(order) == 1
    marked = pairs.withColumn("first", first).withColumn("like", F.when(~F.col("first"), like))
    return marked.groupBy(*by, "tracker_id").agg(F.coalesce(F.avg("like"), F.lit(0.0)).alias("consistency"))


def memory_distances(diag_records: DataFrame, chain_nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, tracker_id, feature, distance): mean similarity to the matched record per feature, without the birth.

    Null distances don't count; a feature that has none is 0. Trackers with
    their birth only have no row.
    """
    key = [*by, "tracker_id", "frame_idx", "record_idx"]
    matched = diag_records.join(with_positions(chain_nodes, by).where("pos > 0").select(*key), key)
    each = matched.select(*by, "tracker_id", F.posexplode("distances").alias("feature", "distance"))
    return each.groupBy(*by, "tracker_id", "feature").agg(F.coalesce(F.avg(F.col("distance").cast("double")), F.lit(0.0)).alias("distance"))


def mean_memory_distances(diag_records: DataFrame, chain_nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, distance): the mean of memory_distances over trackers."""
    return memory_distances(diag_records, chain_nodes, by).groupBy(*by, "feature").agg(F.avg("distance").alias("distance"))


def in_box(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Rows with x and y inside their ranges, ends included."""
    return df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))


def group_results(results: DataFrame, key, columns: list[str], where=None) -> DataFrame:
    """Result rows grouped by an expression of their configuration, as lists of structs."""
    rows = results if where is None else results.where(where)
    return rows.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("results"))


def value_counts(records: DataFrame, names: list[str]) -> DataFrame:
    """(feature, value, n): distinct values of word features with their counts, in one pass over the records."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names))).alias("e")
    return records.select(each).select("e.*").where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def column_similarity_sum(values: DataFrame, column: str, word: str, keys: list[str]) -> DataFrame:
    """(keys, total): plain edit similarities of a column's values to one word, summed; each distinct value is compared once."""
    counts = values.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    value = native_levenshtein(F.col(column), F.lit(word)).cast("double")
    return counts.groupBy(*keys).agg(F.sum(value * F.col("n")).alias("total"))


#: Distinct values of either side of one cell of the grid of consecutive_similarity_sums, about; rows of it at once.
CELL, ROWS = 4096, 64


def consecutive_similarity_sums(records: DataFrame, column: str) -> DataFrame:
    """(frame_idx, total, pairs, computations) of each frame and the next: similarities over all pairs of values, summed.

    Plain edits over characters. ``computations`` are the distinct pairs of
    values that no earlier frame had: pairs are told by the earlier frames that
    either value was in, so they are counted by groups of values. The
    similarities are summed in cells of a grid of values, each a task's group of
    bounded size, by tables of edits.
    """
    counts = stored(records.where(F.col(column).isNotNull()).groupBy("frame_idx", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), "values")
    most = counts.groupBy("frame_idx").count().agg(F.max(F.col("count"))).first()[0] or 0
    parts = max(1, -(-most // CELL))
    mine, other = F.pmod(F.xxhash64("value"), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = counts.withColumn("x", mine).withColumn("y", other)
    right = counts.withColumn("frame_idx", F.col("frame_idx") - 1).withColumn("y", mine).withColumn("x", other)
    left, right = (side.select("frame_idx", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "value", "n") for side in (left, right))

    def summed(a: pa.Table, b: pa.Table) -> pa.Table:
        total, times = 0.0, 0
        if a.num_rows and b.num_rows:
            words, texts = a["value"].to_pylist(), Texts(b["value"].to_pylist(), list)
            na, nb = (t["n"].to_numpy().astype(np.int64) for t in (a, b))
            times, weights = int(na.sum()) * int(nb.sum()), nb[texts.order].astype(np.float64)
            for at in range(0, len(words), ROWS):
                like = character_table(words[at : at + ROWS], texts)
                total += float(na[at : at + ROWS] @ (like.astype(np.float64) @ weights))
            frame = a["frame_idx"][0].as_py()
            return pa.table({"frame_idx": pa.array([frame], pa.int32()), "total": [total], "pairs": [times]})
        return pa.table({"frame_idx": pa.array([], pa.int32()), "total": pa.array([], pa.float64()), "pairs": pa.array([], pa.int64())})

    key = ("frame_idx", "x", "y")
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(summed, "frame_idx int, total double, pairs long")
    sums = sums.groupBy("frame_idx").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    # values by the frames that they were in before
    seen = counts.groupBy("value").agg(F.sort_array(F.collect_set("frame_idx")).alias("frames")).withColumn("here", F.explode("frames"))

    def grouped(name: str, back: int) -> DataFrame:
        earlier = F.transform(F.filter("frames", lambda f: f < F.col("here")), lambda f: f - back)
        return seen.select((F.col("here") - back).alias("frame_idx"), earlier.alias(name)).groupBy("frame_idx", name).agg(F.count(F.lit(1)).alias(f"n_{name}"))

    met = grouped("a", 0).join(grouped("b", 1), "frame_idx").where(~F.arrays_overlap("a", "b"))
    first = met.groupBy("frame_idx").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("computations"))
    return sums.join(first, "frame_idx", "left").select("frame_idx", "total", "pairs", F.coalesce("computations", F.lit(0).cast("long")).alias("computations"))
