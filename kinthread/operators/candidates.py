"""Candidate pairs: which trackers and records can score over a threshold at all.

A score is a weighted mean, so a pair over the threshold lacks less than a
budget in all features together. The budget is shared out among the features by
how few pairs each lets through (looked at in a bounded sample): some feature
must lack less than its part. A feature of few values gets nothing and lets
nothing through by itself. Per feature, words that may be as similar as that
meet in equi-joins on pieces of them; pairs found so are held against the whole
budget before their similarities are computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinthread.config import DistanceMetricConfig, RecordScorerConfig
from kinthread.functions.scorers import score
from kinthread.functions.similarity import _pieces, sigmoid
from kinthread.functions.words import grapheme_array, graphemes, join_graphemes
from kinthread.runtime import stored
from kinthread.schema import ElementType, RecordSchema

#: Rows of either side that the budget's shares are chosen by, and parts that it is dealt in.
SAMPLE, PARTS = 400, 24
#: Scores in single precision differ from those in doubles by less.
SLACK = 1e-4


def memory_name(i: int) -> str:
    return f"m{i}"


def edit_ratio(metric: DistanceMetricConfig, least: float) -> float | None:
    """Words more similar than ``least`` have fewer edits than this share of the longer's bytes; None where no share below 1 is proven.

    ``lv_opti`` never has fewer edits than ``lv``; ``lv_edit`` weighs an edit by
    its smallest weight at least; the sigmoid is monotone, so its bound is that
    of the similarity that it maps there.
    """
    if metric.use_sigmoid:
        if not 0 < least < 1:
            return None
        least = (math.log(least / (1 - least)) + 4) / 8
    ratio = 1 - least
    if metric.metric == "lv_edit":
        smallest = min(metric.lv_edit_weights)
        ratio = ratio / smallest if smallest > 0 else 1.0
    elif metric.metric not in ("lv", "lv_opti"):
        return None
    return ratio if 0 < ratio < 1 else None


def described(words: DataFrame, v: str, ratio: float, more: float = 0.0, text: str | None = None) -> DataFrame:
    """(v, g, b, n, k): a word's graphemes, bytes, number of graphemes, and the edits that a pair of so many bytes may have.

    ``more`` edits are allowed to every pair. ``text`` is a column that is compared instead of the word, whose bytes count.
    """
    t = text or v
    g = F.when(F.octet_length(t) == F.length(t), F.filter(F.split(t, ""), lambda c: c != "")).otherwise(grapheme_array(F.col(t)))
    return words.select(
        v, *([text] if text else []), g.alias("g"), F.octet_length(v).alias("b"), F.size(g).alias("n"),
        F.floor(F.octet_length(v) * ratio + more + 1e-6).cast("int").alias("k"),
    )


def segments(words: DataFrame, v: str) -> DataFrame:
    """(v, b, n, i, segment): a word's graphemes cut into k + 1 even segments; words of fewer graphemes are left out."""
    parts, i = F.col("k") + 1, F.col("i")
    base, first_long = F.floor(F.col("n") / parts).cast("int"), parts - F.col("n") % parts
    begin = i * base + F.greatest(i - first_long, F.lit(0))
    size = base + F.when(i >= first_long, 1).otherwise(0)
    each = words.where("n > k").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    return each.select(v, "b", "n", "i", join_graphemes(F.slice("g", begin + 1, size)).alias("segment"))


def substrings(words: DataFrame, v: str, shapes: DataFrame, strict: bool) -> DataFrame:
    """(v, b, n, i, segment): what of a word may be a segment of a word of each shape (b, n, k) that has at least its bytes.

    If two words are at most k edits apart, some segment of the one stands in
    the other, moved by no more than the edits left and right of it allow.
    """
    fits = (F.col("s.b") > F.col("w.b")) if strict else (F.col("s.b") >= F.col("w.b"))
    pairs = words.alias("w").join(shapes.alias("s"), fits & (F.abs(F.col("s.n") - F.col("w.n")) <= F.col("s.k")))
    pairs = pairs.select(
        F.col(f"w.{v}").alias(v), "w.g", F.col("w.n").alias("own"), "s.b", "s.n", "s.k", F.explode(F.sequence(F.lit(0), F.col("s.k"))).alias("i"),
    )
    parts, i, k = F.col("k") + 1, F.col("i"), F.col("k")
    base, first_long = F.floor(F.col("n") / parts).cast("int"), parts - F.col("n") % parts
    begin = i * base + F.greatest(i - first_long, F.lit(0))
    size = base + F.when(i >= first_long, 1).otherwise(0)
    more = F.col("own") - F.col("n")
    low = F.greatest(F.lit(0), begin - i, begin + more - (k - i))
    high = F.least(F.col("own") - size, begin + i, begin + more + (k - i))
    found = F.when(low <= high, F.transform(F.sequence(low, high), lambda at: join_graphemes(F.slice("g", at + 1, size))))
    return pairs.select(v, "b", "n", "i", F.explode(F.array_distinct(found)).alias("segment"))


def near_words(words1: DataFrame, words2: DataFrame, ratio: float, more: float = 0.0) -> DataFrame:
    """(v1, v2): every pair of words with fewer edits than ``ratio`` times the longer's bytes and ``more``, and some others.

    The word of more bytes allows k edits and is cut into k + 1 segments; the
    other one has one of them, or both are far. Words meet on (shape, number of
    the segment, segment). Words of more bytes than graphemes may have fewer
    graphemes than segments: those meet every word of no more bytes, which then
    are as similar. ASCII words are held against their edit distance at once.
    """
    one, two = (stored(described(w, v, ratio, more), "words") for w, v in ((words1, "v1"), (words2, "v2")))
    keys = ["b", "n", "i", "segment"]

    def shapes(words: DataFrame) -> DataFrame:
        """A row a length of words."""
        return words.where("n > k").select("b", "n", "k").distinct()

    ascii_pair = (F.octet_length("v1") == F.length("v1")) & (F.octet_length("v2") == F.length("v2"))
    size = F.greatest(F.octet_length("v1"), F.octet_length("v2"))
    near = ~ascii_pair | (F.levenshtein("v1", "v2") < size * ratio + (more + 1e-5))
    found = (
        segments(one, "v1").join(substrings(two, "v2", shapes(one), False), keys).select("v1", "v2")
        .union(segments(two, "v2").join(substrings(one, "v1", shapes(two), True), keys).select("v1", "v2"))
    )
    wide1, wide2 = one.where("n <= k and b > 0"), two.where("n <= k and b > 0")
    if not wide1.isEmpty() or not wide2.isEmpty():
        x, y = wide1.select("v1", F.col("b").alias("b1")), two.select("v2", F.col("b").alias("b2"))
        found = found.union(x.join(y, F.col("b2") <= F.col("b1")).select("v1", "v2"))
        x, y = one.select("v1", F.col("b").alias("b1")), wide2.select("v2", F.col("b").alias("b2"))
        found = found.union(x.join(y, F.col("b1") < F.col("b2")).select("v1", "v2"))
    return found.where(near).distinct()


def _plain(metric: DistanceMetricConfig, least: float) -> float | None:
    """1 less the similarity before the sigmoid; None where every pair may be over ``least``."""
    if metric.use_sigmoid:
        if not 0 < least < 1:
            return None
        least = (math.log(least / (1 - least)) + 4) / 8
    return 1 - least if 0 < least < 1 else None


def run_share(metric: DistanceMetricConfig, least: float) -> tuple[float, float] | None:
    """(share, ratio) for ``lv_substring``: words more similar than ``least`` have a common run of that share
    of the longer's bytes, or fewer edits than ``ratio`` times them.

    A run of length q takes weight * q off the edits. Half of what is left up to 1 goes to either side.
    """
    base = _plain(metric, least)
    if base is None:
        return None
    weight = metric.lv_substring_weight
    if weight <= 0:
        return 1.0, base
    share = min(1.0, (1 - base) / (2 * weight))
    return share, base + weight * share


def common_runs(words1: DataFrame, words2: DataFrame, share: float) -> DataFrame:
    """(v1, v2): every pair of words with a common run of at least ``share`` of the longer's bytes.

    Such words share a gram of that length: the longer word gives all of its
    own length, the other those of every length of bytes that is no smaller
    than its own. Words meet on (bytes of the longer, gram).
    """
    one, two = (stored(described(w, v, 0.0).drop("k").where("n > 0"), "words") for w, v in ((words1, "v1"), (words2, "v2")))
    length = F.greatest(F.ceil(F.col("b") * share - 1e-6).cast("int"), F.lit(1))

    def grams(words: DataFrame, v: str) -> DataFrame:
        starts = F.when(F.col("q") <= F.col("n"), F.sequence(F.lit(1), F.col("n") - F.col("q") + 1))
        return words.select(v, "b", F.explode(F.array_distinct(F.transform(starts, lambda i: join_graphemes(F.slice("g", i, F.col("q")))))).alias("gram"))

    def other(words: DataFrame, v: str, sizes: DataFrame, strict: bool) -> DataFrame:
        fits = F.col("size") > F.col("b") if strict else F.col("size") >= F.col("b")
        met = words.join(F.broadcast(sizes.select(F.col("b").alias("size")).distinct()), fits)  # a row a length of words
        return grams(met.withColumn("b", F.col("size")).withColumn("q", length), v)

    found = (
        grams(one.withColumn("q", length), "v1").join(other(two, "v2", one, False), ["b", "gram"]).select("v1", "v2")
        .union(grams(two.withColumn("q", length), "v2").join(other(one, "v1", two, True), ["b", "gram"]).select("v1", "v2"))
    )
    return found.distinct()


def split_words(column: Column, separator: str) -> Column:
    """array<string>: the parts of a word list as ``lv_multiword`` has them."""

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            yield pa.array([None if w is None else ["".join(p) for p in _pieces(graphemes(w), separator)] for w in words.to_pylist()], pa.list_(pa.string()))

    return split(column)


def near_lists(words1: DataFrame, words2: DataFrame, separator: str, ratio: float) -> DataFrame:
    """(v1, v2): every pair that ``lv_multiword`` may give fewer edits than ``ratio`` times the longer's bytes, and some others.

    With as many parts, the sum over positions is scaled by the imperfect share
    and truncated: either some part is equal in its place (they meet on number
    of parts, place and part), or the sum, of which the edits of the whole are
    no more, is under the bound and one. Doubled or outer separators, which the
    parts don't have but the whole does, are left out in a comparison of their own.
    """
    one, two = (stored(w.withColumn("parts", split_words(F.col(v), separator)), "parts") for w, v in ((words1, "v1"), (words2, "v2")))

    def parts(words: DataFrame, v: str) -> DataFrame:
        return words.where(F.size("parts") > 1).select(v, F.size("parts").alias("of"), F.posexplode("parts").alias("place", "part"))

    found = near_words(words1, words2, ratio, 1.0).union(
        parts(one, "v1").join(parts(two, "v2"), ["of", "place", "part"]).select("v1", "v2"))
    whole = [w.select(v, F.array_join("parts", separator).alias("text")) for w, v in ((one, "v1"), (two, "v2"))]
    odd = [not w.where(F.col("text") != F.col(v)).isEmpty() for w, v in zip(whole, ("v1", "v2"), strict=True)]
    if any(odd):
        # the words without those, allowed what the longest original is
        most = max(w.agg(F.max(F.octet_length(v) - F.octet_length("text"))).first()[0] or 0 for w, v in zip(whole, ("v1", "v2"), strict=True))
        near = near_words(whole[0].select(F.col("text").alias("v1")).distinct(), whole[1].select(F.col("text").alias("v2")).distinct(), ratio, 1.0 + ratio * most)
        a, b = (w.withColumnRenamed("text", f"t{i}") for i, w in enumerate(whole, 1))
        found = found.union(near.select(F.col("v1").alias("t1"), F.col("v2").alias("t2")).join(a, "t1").join(b, "t2").select("v1", "v2"))
    return found.distinct()


def bounded(metric: DistanceMetricConfig, least: float) -> bool:
    """Whether ``similar_words`` can tell pairs under ``least``."""
    if metric.metric == "lv_substring":
        found = run_share(metric, least)
        return found is not None and found[1] < 1
    if metric.metric == "lv_multiword":
        return _plain(metric, least) is not None
    return edit_ratio(metric, least) is not None


def similar_words(words1: DataFrame, words2: DataFrame, metric: DistanceMetricConfig, least: float) -> DataFrame:
    """(v1, v2): every pair of words (distinct, v1 and v2) more similar than ``least``, and some others; see ``bounded``."""
    if metric.metric == "lv_substring":
        share, ratio = run_share(metric, least)
        return near_words(words1, words2, ratio).union(common_runs(words1, words2, share)).distinct()
    if metric.metric == "lv_multiword":
        return near_lists(words1, words2, metric.lv_multiword_separator, _plain(metric, least))
    return near_words(words1, words2, edit_ratio(metric, least))


class Budget:
    """What a pair over the threshold may lack: a feature lacks 1 - similarity, or 1 - its square."""

    def __init__(self, scorer: RecordScorerConfig, features: int, threshold: float):
        self.average = scorer.record_scorer == "average"
        self.weights = [1.0] * features if self.average else [float(w) for w in scorer.weights]
        self.power = 2 if scorer.record_scorer == "weighted-quadratic" else 1
        self.threshold = threshold
        self.total = (1 - threshold) * sum(self.weights)

    def least(self, lacks: float) -> float:
        """The similarity over which a feature lacks less."""
        return max(0.0, 1 - lacks) ** (1 / self.power) - 1e-6

    def shares(self, lacking: Sequence[np.ndarray], metric: DistanceMetricConfig) -> list[float] | None:
        """What each feature may lack, so that all use up the budget and the fewest pairs (of a sample) lack less in one of them.

        None where no such shares are below what the metric can tell.
        """
        if not 0 < self.threshold < 1 or min(self.weights) < 0 or sum(self.weights) <= 0:
            return None
        # least cost of each number of parts dealt, and the parts of the features so far
        best: list[tuple[float, tuple[int, ...]] | None] = [(0.0, ())] + [None] * PARTS
        for w, lacks in zip(self.weights, lacking, strict=True):
            costs = {0: 0.0}
            for i in range(1, PARTS + 1):
                part = i * self.total / PARTS / w if w > 0 else 1.0
                if part < 1 and bounded(metric, self.least(part)):
                    costs[i] = float(np.mean(lacks < part)) + 1e-9 * i if lacks.size else float(i)
            new: list[tuple[float, tuple[int, ...]] | None] = [None] * (PARTS + 1)
            for dealt, state in enumerate(best):
                for i, cost in costs.items() if state is not None else ():
                    at = min(PARTS, dealt + i)
                    if new[at] is None or state[0] + cost < new[at][0]:
                        new[at] = (state[0] + cost, (*state[1], i))
            best = new
        if best[PARTS] is None:
            return None
        return [i * self.total / PARTS / w if i else 0.0 for i, w in zip(best[PARTS][1], self.weights, strict=True)]


def _reached(trackers: DataFrame, records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig, leasts: Sequence[float | None]) -> DataFrame:
    """(tracker_id, record_idx) with words of some feature more similar than its least one; None leaves a feature out."""
    found = None
    for i, (field, least) in enumerate(zip(schema.fields, leasts, strict=True)):
        if least is None:
            continue
        cell = F.explode(field.name) if field.dtype is ElementType.MultiStrings else F.col(field.name)
        left = trackers.select("tracker_id", F.explode(F.flatten(memory_name(i))).alias("v1")).distinct()
        right = records.select("record_idx", cell.alias("v2")).where("v2 is not null").distinct()
        near = similar_words(left.select("v1").distinct(), right.select("v2").distinct(), metric, least)
        part = left.join(near, "v1").join(right, "v2").select("tracker_id", "record_idx")
        found = part if found is None else found.union(part)
    return found


def best_bound(i: int, name: str, dtype: ElementType, metric: DistanceMetricConfig) -> Column:
    """No smaller than feature ``i``'s similarity, null without one: by edit distance where all is ASCII and the metric is bounded by it, else 1."""
    memory, cell = F.col(memory_name(i)), F.col(name)
    present = (F.size(F.filter(memory, lambda e: F.size(e) > 0)) > 0) & cell.isNotNull()
    smallest = {"lv": 1.0, "lv_opti": 1.0}.get(metric.metric, min(metric.lv_edit_weights) if metric.metric == "lv_edit" else 0.0)
    one = F.lit(1.0)
    if dtype is not ElementType.String or smallest <= 0:
        return F.when(present, one).cast("float")

    def bound(element: Column) -> Column:
        word = F.get(element, 0)
        size = F.greatest(F.octet_length(word), F.octet_length(cell))
        ascii_pair = (F.octet_length(word) == F.length(word)) & (F.octet_length(cell) == F.length(cell)) & (size > 0)
        value = one - F.levenshtein(word, cell) * smallest / size
        return F.when(ascii_pair, sigmoid(value).cast("double") if metric.use_sigmoid else value).otherwise(one)

    return F.when(present, F.array_max(F.transform(F.filter(memory, lambda e: F.size(e) > 0), bound))).cast("float")


def candidates(
    trackers: DataFrame, records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig, scorer: RecordScorerConfig,
    threshold: float, lacking: Sequence[np.ndarray],
) -> DataFrame | None:
    """``trackers`` joined to ``records``: all pairs that may score over ``threshold``; None where the metric can't tell.

    ``lacking`` has what the features lack in a sample of pairs (absent ones: 1
    and more). Weighted scorers divide by the features that are there: a pair
    that lacks one which gets more than its even share has a smaller budget, so
    rows without such a feature meet by even shares, which hold for any of them.
    """
    budget = Budget(scorer, len(schema.fields), threshold)
    shares = budget.shares(lacking, metric)
    if shares is None:
        return None
    keys = _reached(trackers, records, schema, metric, [budget.least(s) if s > 0 else None for s in shares])
    raised = [i for i, s in enumerate(shares) if s > 1 - threshold + 1e-9]
    if raised and not budget.average:
        even = [budget.least(1 - threshold) if w > 0 else None for w in budget.weights]
        if not all(e is None or bounded(metric, e) for e in even):
            return None
        whole_tracker = F.lit(True)
        whole_record = F.lit(True)
        for i in raised:
            whole_tracker &= F.coalesce(F.size(F.filter(memory_name(i), lambda e: F.size(e) > 0)) > 0, F.lit(False))
            whole_record &= F.col(schema.fields[i].name).isNotNull()
        odd_trackers, odd_records = trackers.where(~whole_tracker), records.where(~whole_record)
        if not odd_trackers.isEmpty():
            keys = keys.union(_reached(odd_trackers, records, schema, metric, even))
        if not odd_records.isEmpty():
            keys = keys.union(_reached(trackers.where(whole_tracker), odd_records, schema, metric, even))
    most = score(scorer, [best_bound(i, f.name, f.dtype, metric) for i, f in enumerate(schema.fields)])
    return keys.distinct().join(trackers, "tracker_id").join(records, "record_idx").where(most > threshold - SLACK)
