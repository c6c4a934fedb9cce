"""Clusters of words by average linkage, and normalisation by their medians."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinthread.config import NormalizationConfig, DistanceMetricConfig
from kinthread.functions.similarity import similarity_table
from kinthread.functions.words import median_word


def average_linkage(matrix: np.ndarray, threshold: float) -> list[list[int]]:
    """Clusters of rows: the most similar pair over ``threshold`` is merged until there is none.

    Similarities to a merged cluster are means weighted by size; float32; the
    first pair in row order wins ties; the last cluster takes the place of the
    one merged away. Every row keeps its best partner, so a merge looks at two
    rows and at those whose best it changes, not at the whole matrix.
    """
    sim = np.array(matrix, dtype=np.float32)
    np.fill_diagonal(sim, 0)
    size = len(sim)
    parts = [[i] for i in range(size)]

    def best_of(rows: np.ndarray) -> None:
        some = np.where(np.isnan(sim[rows, :size]), -np.inf, sim[rows, :size])
        partner[rows] = np.argmax(some, axis=1)
        best[rows] = some[np.arange(len(rows)), partner[rows]]

    best, partner = np.full(size, -np.inf, dtype=np.float32), np.zeros(size, dtype=np.int64)
    for low in range(0, size, 1024):
        best_of(np.arange(low, min(size, low + 1024)))
    while size > 1:
        i = int(np.argmax(best[:size]))
        j = int(partner[i])
        if not sim[i, j] > threshold:
            break
        i, j = min(i, j), max(i, j)
        a, b = np.float32(len(parts[i])), np.float32(len(parts[j]))
        row = (sim[i, :size] * a + sim[j, :size] * b) / (a + b)
        column = (sim[:size, i] * a + sim[:size, j] * b) / (a + b)
        sim[i, :size], sim[:size, i] = row, column
        sim[i, i] = 0
        parts[i] = sorted(parts[i] + parts[j])
        last = size - 1
        stale = (partner[:size] == i) | (partner[:size] == j)
        if j != last:
            sim[j, :size], sim[:size, j] = sim[last, :size].copy(), sim[:size, last].copy()
            sim[j, j] = 0
            parts[j] = parts[last]
            stale[j] = True
            best[j], partner[j] = best[last], partner[last]
        stale[i] = True
        parts.pop()
        size = last
        stale = stale[:size]
        # a best partner that has moved, to a place before others as good
        moved = np.flatnonzero(~stale & ((partner[:size] == last) | ((sim[:size, j] == best[:size]) & (j < partner[:size])))) if j < size else np.zeros(0, np.int64)
        partner[moved] = np.where(partner[moved] == last, j, np.minimum(partner[moved], j))
        stale[moved] = True  # others as good may stand before it
        better = np.flatnonzero(~stale & ((sim[:size, i] > best[:size]) | ((sim[:size, i] == best[:size]) & (i < partner[:size]))))
        best[better], partner[better] = sim[better, i], i
        best_of(np.flatnonzero(stale))
    return parts


def similarity_matrix(words: Sequence[str], metric: DistanceMetricConfig) -> np.ndarray:
    """All ordered pairs; each distinct pair is computed once."""
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    values = similarity_table(metric, list(place), list(place))
    at = [place[w] for w in words]
    return values[np.ix_(at, at)]


def word_clusters(words: Sequence[str], metric: DistanceMetricConfig, threshold: float) -> list[list[int]]:
    """Clusters of positions in ``words``."""
    return average_linkage(similarity_matrix(words, metric), threshold) if words else []


def clusters_of_words(words: Sequence[str], metric: DistanceMetricConfig, threshold: float) -> list[list[str]]:
    """Clusters as lists of the words themselves."""
    return [[words[i] for i in cluster] for cluster in word_clusters(words, metric, threshold)]


def word_clusters_udf(metric: DistanceMetricConfig, threshold: float):
    """Column function: the clusters of an array of words, array<array<string>>."""

    @F.arrow_udf("array<array<string>>")
    def clusters(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else clusters_of_words(w, metric, threshold) for w in words.to_pylist()], pa.list_(pa.list_(pa.string())))

    return clusters


def _medians(words: Sequence[str | None], rules: NormalizationConfig) -> tuple[list[str], list[int | None]]:
    """Median word of every cluster that is large enough, and each position's cluster."""
    place = [i for i, w in enumerate(words) if w is not None]
    found = word_clusters([words[i] for i in place], rules.distance_metric, rules.threshold_cluster_match)
    medians, of = [], [None] * len(words)
    for cluster in (c for c in found if len(c) >= rules.min_cluster_size):
        for i in cluster:
            of[place[i]] = len(medians)
        medians.append(median_word([words[place[i]] for i in cluster]))
    return medians, of


def fill_nearest(of: Sequence[int | None]) -> list[int | None]:
    """Missing ones take the last to the left, or else the next to the right."""
    out, last = [], next((x for x in of if x is not None), None)
    for x in of:
        last = x if x is not None else last
        out.append(last)
    return out


def normalize_words(words: Sequence[str | None], rules: NormalizationConfig) -> list[str | None]:
    """Each word of a chain as its cluster's median.

    Without a cluster the words stay. Otherwise missing clusters are inferred,
    for null words too, if the rules say so; else unclustered words stay.
    """
    medians, of = _medians(words, rules)
    if not medians:
        return list(words)
    if rules.infer_missing_clusters:
        of = fill_nearest(of)
    return [w if c is None else medians[c] for w, c in zip(words, of, strict=True)]


def normalize_multi_words(cells: Sequence[Sequence[str] | None], rules: NormalizationConfig) -> list[list[str]]:
    """Lists of a chain: each cluster's median in every position from its first to its last word.

    Words without a cluster are dropped; a list has its clusters in order.
    """
    flat = [(i, w) for i, cell in enumerate(cells) for w in (cell if cell is not None else [])]
    medians, of = _medians([w for _, w in flat], rules)
    spans: dict[int, list[int]] = {}
    for (i, _), c in zip(flat, of, strict=True):
        if c is not None:
            low, high = spans.setdefault(c, [i, i])
            spans[c] = [min(low, i), max(high, i)]
    return [[medians[c] for c in range(len(medians)) if spans[c][0] <= i <= spans[c][1]] for i in range(len(cells))]


def fill_missing(chains: DataFrame, column: str = "value") -> DataFrame:
    """``chains`` (tracker_id, frame_idx, ...): a missing ``column`` takes the last to the left, or else the next to the right."""
    order = Window.partitionBy("tracker_id").orderBy("frame_idx")
    left = F.last(column, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(column, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return chains.withColumn(column, F.coalesce(left, right))


def fill_spans(chains: DataFrame, column: str = "value") -> DataFrame:
    """(tracker_id, frame_idx, column): each value of a chain at all its nodes from the value's first to its last."""
    nodes = chains.select("tracker_id", "frame_idx", column)
    spans = (
        nodes.where(F.col(column).isNotNull()).groupBy("tracker_id", column)
        .agg(F.min("frame_idx").alias("low"), F.max("frame_idx").alias("high"))
        .groupBy("tracker_id").agg(F.collect_list(F.struct(column, "low", "high")).alias("spans"))  # a chain's values, a frame each at most
    )
    each = nodes.select("tracker_id", "frame_idx").join(spans, "tracker_id").select("tracker_id", "frame_idx", F.explode("spans").alias("s"))
    return each.where("frame_idx BETWEEN s.low AND s.high").select("tracker_id", "frame_idx", F.col("s")[column].alias(column))
