"""Scoring records against trackers: candidate pairs, similarities, scores, ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinthread.config import DistanceMetricConfig, RecordScorerConfig
from kinthread.functions.scorers import RowScorer, interesting, last_digits, score
from kinthread.functions.similarity import bounded, pairs_table, quick_rows, quick_table, similarities, similarity_table
from kinthread.functions.tables import LONGEST, Prefixes, Texts
from kinthread.operators.candidates import SAMPLE, SLACK, candidates, memory_name
from kinthread.operators.word_pairs import WordPairs, joined_similarities
from kinthread.runtime import stored
from kinthread.schema import ElementType, RecordSchema

#: Pairs up to which every tracker meets every record; beyond, pairs are blocked
#: where the metric allows it without loss.
ALL_PAIRS = 50_000_000
#: Records that may go to every task.
BROADCAST_RECORDS = 200_000
#: Rows of one batch of pairs.
PAIRS = 8192
#: Words of a record's lists up to which each has an array of its own; pairs of words from which a table is quicker than pairs.
WIDE, QUICK = 8, 4096
#: Pairs that are scanned by tables of words where the metric has a quick one: fewer take candidates if they must, more do too.
SCANNED = (1 << 20, 1 << 38)
QUICK_METRICS = ("lv", "lv_opti", "lv_substring", "lv_multiword")
#: Share of a batch's pairs under which the rest of their features goes pair by pair; pairs of a step of that, and of a batch given out.
SPARSE, FEW, GIVEN = 1 / 64, 1 << 16, 1 << 16
#: Share of a batch's pairs that bounds of similarities must leave at most for the rest to go pair by pair; words from which a feature is bounded.
BOUNDED, MANY_WORDS = 1 / 4, 1024
#: Tasks a core of a scan.
ROUNDS = 4
#: Scores of a row that Python gives out, and of a batch; words of a feature up to which rows of similarities are kept, and how many are.
LISTED, LISTS, REPEATED = 300, 1 << 18, 64
#: Digits up to which a score in units of the last one is an int.
DIGITS = 6
#: Records that tasks rank, some hundred bytes each; over any score in units of its last digit.
RANKED, TOP = 2_000_000, 1 << 30


def pair_similarities(pairs: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig) -> DataFrame:
    """(tracker_id, record_idx, distances array<float>) of pairs with memories m0.. and the record's features.

    Per feature the best similarity over the memory's elements: null for an
    empty memory or a null cell; NaN only if no element gives a number. Each
    distinct pair of words of a batch is computed once.
    """
    names = schema.names
    multi = [f.dtype is ElementType.MultiStrings for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                columns = [_feature(part[memory_name(i)], part[name], multi[i], metric) for i, name in enumerate(names)]
                values = np.stack([v for v, _ in columns], axis=1).reshape(-1)
                missing = ~np.stack([p for _, p in columns], axis=1).reshape(-1)
                ends = pa.array(np.arange(part.num_rows + 1) * len(names), pa.int32())
                distances = pa.ListArray.from_arrays(ends, pa.array(values, pa.float32(), mask=missing))
                yield pa.RecordBatch.from_arrays([part["tracker_id"], part["record_idx"], distances], ["tracker_id", "record_idx", "distances"])

    wanted = ["tracker_id", "record_idx", *(memory_name(i) for i in range(len(names))), *names]
    return pairs.select(*wanted).mapInArrow(run, "tracker_id long, record_idx long, distances array<float>")


def _lists(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(lengths, 0 for null lists; the items) of a list column."""
    return pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(values)


def _inside(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. of each of so many."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _best_of(values: np.ndarray, lengths: np.ndarray, without: float) -> np.ndarray:
    """Largest number of each run of values; ``without`` for a run of none."""
    out = np.full(len(lengths), without, dtype=np.float32)
    some = np.flatnonzero(lengths)
    if len(some):
        out[some] = np.fmax.reduceat(values, (np.cumsum(lengths) - lengths)[some])
    return out


def _feature(memory: pa.Array, cells: pa.Array, multi: bool, metric: DistanceMetricConfig) -> tuple[np.ndarray, np.ndarray]:
    """(best similarity, whether there is one) per row for one feature."""
    elements, inner = _lists(memory)
    elements = np.where(cells.is_valid().to_numpy(zero_copy_only=False), elements, 0)
    if multi:
        rights, right_words = _lists(cells)
    else:
        rights, right_words = cells.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), cells.drop_null()
    words, left_words = _lists(inner)
    # rows of elements, elements of words; those of null cells are left out
    every = _lists(memory)[0]
    row_of = np.repeat(np.arange(len(every)), every)
    used = np.repeat(elements > 0, every)
    word_used = np.repeat(used, words)
    row_of, words = row_of[used], words[used]
    left = pc.dictionary_encode(left_words.filter(pa.array(word_used)))
    right = pc.dictionary_encode(right_words)
    a = left.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    b = right.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # every left word meets the right words of its row
    element_of = np.repeat(np.arange(len(words)), words)
    row = row_of[element_of]
    times = rights[row]
    begins = np.cumsum(rights) - rights
    pairs = np.repeat(a, times) * max(1, len(right.dictionary)) + b[np.repeat(begins[row], times) + _inside(times)]
    distinct, place = np.unique(pairs, return_inverse=True)
    lefts, others = left.dictionary.to_pylist(), right.dictionary.to_pylist()
    n = max(1, len(others))
    values = similarities(metric, [lefts[i] for i in (distinct // n).tolist()], [others[i] for i in (distinct % n).tolist()])
    per_word = _best_of(values[place] if len(values) else values, times, 0.0)
    total = np.zeros(len(words), dtype=np.float32)
    at = _inside(words)
    for turn in range(int(words.max(initial=0))):  # word after word, as sums in single precision go
        mine = at == turn
        total[element_of[mine]] += per_word[mine]
    if multi:
        total = total / np.maximum(np.maximum(words, rights[row_of]), 1).astype(np.float32)
    kept = words > 0
    counts = np.bincount(row_of[kept], minlength=len(every))
    return _best_of(total[kept], counts, 0.0), counts > 0


class RecordSide:
    """A frame's records for numpy: per feature its distinct words and which of them a record has."""

    def __init__(self, columns: list[list], multi: list[bool]):
        self.multi, self.texts, self.places, self.lengths, self.flat = multi, [], [], [], []
        for cells, lists in zip(columns, multi, strict=True):
            place: dict[str, int] = {}
            rows = [[] if c is None else ([place.setdefault(w, len(place)) for w in (c if lists else [c])]) for c in cells]
            lengths = np.array([-1 if c is None else len(r) for c, r in zip(cells, rows, strict=True)], dtype=np.int64)
            texts = Texts(list(place))
            rank = np.zeros(max(1, len(place)), dtype=np.intp)
            rank[texts.order] = np.arange(len(place))
            self.texts.append(texts)
            self.lengths.append(lengths)
            flat = np.array([rank[i] for r in rows for i in r], dtype=np.intp)
            begins = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
            self.flat.append((flat, begins))
            if lengths.max(initial=0) <= WIDE:
                # the k-th word of each record; lists of fewer repeat their first
                at = [begins + np.where(lengths > k, k, 0) for k in range(max(1, int(lengths.max(initial=0))))]
                self.places.append([np.where(lengths > 0, flat[np.minimum(i, len(flat) - 1)], 0) if len(flat) else np.zeros(len(lengths), dtype=np.intp) for i in at])
            else:
                self.places.append((flat, begins))

    def cost(self, f: int) -> int:
        """What feature ``f`` takes, roughly."""
        return (len(self.texts[f]) * max(1, self.texts[f].longest) + len(self.lengths[f])) * (4 if self.multi[f] else 1)

    def _per_record(self, f: int, table: np.ndarray) -> np.ndarray:
        """Of similarities (words, the feature's words) the best of each record's words; records without one have 0."""
        some = self.lengths[f] > 0
        if isinstance(self.places[f], list):
            out = table.take(self.places[f][0], axis=1)
            for places in self.places[f][1:]:
                np.fmax(out, table.take(places, axis=1), out=out)
            if not some.all():
                out[:, ~some] = 0
            return out
        out = np.zeros((len(table), len(some)), dtype=np.float32)
        flat, begins = self.places[f]
        if some.any():
            out[:, some] = np.fmax.reduceat(table[:, flat], begins[some], axis=1)
        return out

    def similarity(self, f: int, memories: list, metric: DistanceMetricConfig) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, present) of trackers x records for feature ``f``."""
        lengths, texts = self.lengths[f], self.texts[f]
        out = np.zeros((len(memories), len(lengths)), dtype=np.float32)
        present = np.zeros(out.shape, dtype=bool)
        place: dict[str, int] = {}
        for memory in memories:
            for element in memory or []:
                for w in element:
                    place.setdefault(w, len(place))
        if not place or not len(texts) and not self.multi[f]:
            return out, present
        table = np.zeros((len(place), 1), dtype=np.float32)
        if len(texts):
            table = quick_table(metric, list(place), texts) if len(place) * len(texts) > QUICK else None
            if table is None:
                table = similarity_table(metric, list(place), texts.words)
        some = lengths > 0
        per_word = self._per_record(f, table) if self.multi[f] else None
        for t, memory in enumerate(memories):
            best = None
            for rows in dict.fromkeys(tuple(place[w] for w in element) for element in memory or [] if len(element)):
                if self.multi[f]:
                    value = np.zeros(len(lengths), dtype=np.float32)
                    for r in rows:
                        value += per_word[r]
                    value /= np.maximum(len(rows), lengths).astype(np.float32)
                else:
                    value = table[rows[0]]
                best = value if best is None else np.fmax(best, value)
            if best is None:
                continue
            if self.multi[f]:
                out[t], present[t] = best, lengths >= 0
            else:
                np.take(best, self.places[f][0], out=out[t], mode="clip")
                present[t] = some
        if not self.multi[f] and not some.all():
            out[:, ~some] = 0
        return out, present


    def bounds(self, f: int, memories: list) -> Callable[[int], np.ndarray] | None:
        """What gives of a tracker (its number) a row that its similarities aren't over, for feature ``f``; None if a word is too long.

        The next call takes the same array. Row by row: a row stays in the processor's cache, a table of trackers and records doesn't.
        """
        lengths, texts, places = self.lengths[f], self.texts[f], self.places[f]
        place: dict[str, int] = {}
        elements = [list(dict.fromkeys(tuple(place.setdefault(w, len(place)) for w in e) for e in memory or [] if len(e))) for memory in memories]
        nothing = np.zeros(len(lengths), dtype=np.float32)
        if not len(texts) or not place:
            return lambda t: nothing
        table = texts.bounds(list(place))
        if table is None or not isinstance(places, list):
            return None
        none = np.flatnonzero(lengths <= 0)
        one, two, each, best = (np.empty(len(lengths), dtype=np.float32) for _ in range(4))
        sizes: dict[int, np.ndarray] = {}

        def of_word(w: int, out: np.ndarray) -> None:
            np.take(table[w], places[0], out=out, mode="clip")
            for more in places[1:]:
                np.fmax(out, np.take(table[w], more, out=two, mode="clip"), out=out)

        def of(t: int) -> np.ndarray:
            if not elements[t]:
                return nothing
            for k, rows in enumerate(elements[t]):
                value = one if k else best
                if self.multi[f]:
                    value[:] = 0
                    for w in rows:
                        of_word(w, each)
                        value += each
                    if len(rows) not in sizes:
                        sizes[len(rows)] = 1 / np.maximum(len(rows), lengths).astype(np.float32)
                    value *= sizes[len(rows)]
                else:
                    of_word(rows[0], value)
                if k:
                    np.fmax(best, value, out=best)
            best[none] = 0
            return best

        return of

    def similarity_of(self, f: int, memories: list, metric: DistanceMetricConfig, t: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """``similarity`` of single pairs: trackers ``t`` and records ``r`` by number; None where the metric has no quick form."""
        place: dict[str, int] = {}
        elements = [list(dict.fromkeys(tuple(place.setdefault(w, len(place)) for w in e) for e in memory or [] if len(e))) for memory in memories]
        counts = np.array([len(e) for e in elements], dtype=np.int64)
        sizes = np.array([len(e) for of in elements for e in of], dtype=np.int64)
        words = np.array([w for of in elements for e in of for w in e], dtype=np.int64)
        (flat, begins), lengths = self.flat[f], self.lengths[f][r]
        present = (counts[t] > 0) & (lengths >= 0 if self.multi[f] else lengths > 0)
        # pairs of elements, of words of theirs, of words of the record
        some = np.where(present, counts[t], 0)
        pair = np.repeat(np.arange(len(t)), some)
        element = (np.cumsum(counts) - counts)[t[pair]] + _inside(some)
        size = sizes[element]
        of = np.repeat(np.arange(len(element)), size)
        word = words[(np.cumsum(sizes) - sizes)[element[of]] + _inside(size)]
        others = np.maximum(lengths, 0)[pair[of]]
        a = np.repeat(word, others)
        b = flat[np.repeat(begins[r[pair[of]]], others) + _inside(others)]
        values = np.empty(len(a), dtype=np.float32)
        left = list(place)
        for at in range(0, len(a), 4 * FEW):
            found = pairs_table(metric, left, self.texts[f], a[at : at + 4 * FEW], b[at : at + 4 * FEW])
            if found is None:
                return None
            values[at : at + len(found)] = found
        per_word = _best_of(values, others, 0.0)
        total, turn_of = np.zeros(len(element), dtype=np.float32), _inside(size)
        for turn in range(int(size.max(initial=0))):  # word after word, as sums in single precision go
            mine = turn_of == turn
            total[of[mine]] += per_word[mine]
        if self.multi[f]:
            total /= np.maximum(size, lengths[pair]).astype(np.float32)
        return _best_of(total, some, 0.0), present


class ScoredRecords:
    """A frame's records for rows of similarities, ordered so that the costliest feature's words lie as their trees have them."""

    def __init__(self, ids: np.ndarray, columns: list[list], multi: list[bool], metric: DistanceMetricConfig):
        self.metric, self.multi, self.trees, ranks = metric, multi, [], []
        lengths = [np.array([-1 if c is None else len(c) if lists else 1 for c in cells], dtype=np.int64) for cells, lists in zip(columns, multi, strict=True)]
        for cells, lists, size in zip(columns, multi, lengths, strict=True):
            of = [c or [] for c in cells] if lists else [[] if c is None else [c] for c in cells]
            tree = Prefixes(list(dict.fromkeys(w for words in of for w in words))) if metric.metric == "lv" and size.max(initial=0) <= WIDE else None
            self.trees.append(tree if tree is not None and tree.longest <= LONGEST else None)
            rank = {} if self.trees[-1] is None else {w: i for i, w in enumerate(tree.words)}
            # the k-th word of each record; lists of fewer repeat their first
            ranks.append([
                np.array([rank[words[k if k < len(words) else 0]] if words else 0 for words in of], dtype=np.intp) for k in range(max(1, int(size.max(initial=0))))
            ] if self.trees[-1] is not None else [])
        costs = [0 if tree is None or lists else len(tree) * tree.longest for tree, lists in zip(self.trees, multi, strict=True)]
        order = np.argsort(np.where(lengths[first := int(np.argmax(costs))] > 0, ranks[first][0], -1), kind="stable") if any(costs) else np.arange(len(ids))
        self.ids, self.places, self.lengths = ids[order], [[one[order] for one in of] for of in ranks], [size[order] for size in lengths]
        self.has = [size >= 0 for size in self.lengths]
        for f, tree in enumerate(self.trees):
            # words that lie as the records do aren't looked up
            if tree is not None and len(self.places[f]) == 1 and np.array_equal(self.places[f][0], np.arange(len(tree))):
                self.places[f] = []
        self.others = [f for f, tree in enumerate(self.trees) if tree is None]
        self.side = RecordSide([[columns[f][i] for i in order.tolist()] for f in self.others], [multi[f] for f in self.others]) if self.others else None

    def rows(self, f: int, memories: list, kept: dict) -> Callable[[int], np.ndarray | None]:
        """What gives a tracker's similarities (by its number) for feature ``f``, 0 for records without it; None for a tracker without it.

        ``kept`` outlives the batch; rows are not to be changed.
        """
        tree, places, lengths, multi = self.trees[f], self.places[f], self.lengths[f], self.multi[f]
        if tree is None:
            values, _ = self.side.similarity(self.others.index(f), memories, self.metric)
            return lambda t: values[t] if any(len(e) for e in memories[t] or []) else None
        known = [tuple(dict.fromkeys(tuple(e) if multi else (e[0],) for e in memory or [] if len(e))) for memory in memories]
        if not len(tree):
            nothing = np.zeros(len(self.ids), dtype=np.float32)
            return lambda t: nothing if known[t] else None
        few = len(tree) <= REPEATED
        place: dict[str, int] = {}
        for of in known:
            # rows that are kept need no edits
            for e in () if few and of in kept else of:
                for w in e:
                    place.setdefault(w, len(place))
        one = quick_rows(self.metric, list(place), tree)
        lacks = np.flatnonzero(lengths <= 0)
        sizes: dict[int, np.ndarray] = {}

        def of_word(w: str) -> np.ndarray:
            value = one(place[w])
            if not places:
                return value
            out = value.take(places[0], mode="clip")
            for more in places[1:]:
                np.fmax(out, value.take(more, mode="clip"), out=out)
            return out

        def of_list(words: tuple[str, ...], made: dict) -> np.ndarray:
            total = np.zeros(len(lengths), dtype=np.float32)
            for w in words:
                if w not in made:
                    made[w] = of_word(w)
                total += made[w]
            if len(words) not in sizes:
                sizes[len(words)] = np.maximum(len(words), lengths).astype(np.float32)
            return np.divide(total, sizes[len(words)], out=total)

        def row(t: int) -> np.ndarray | None:
            if not known[t]:
                return None
            if known[t] in kept:
                return kept[known[t]]
            best, made = None, {}
            for e in known[t]:
                value = of_list(e, made) if multi else of_word(e[0])
                best = value if best is None else np.fmax(best, value, out=best)
            best[lacks] = 0
            if few and len(kept) < REPEATED:
                kept[known[t]] = best
            return best

        return row


class Bound:
    """What pairs of trackers and records may score, feature after feature, in single precision: SLACK is far over its error."""

    def __init__(self, scorer: RecordScorerConfig, features: int, threshold: float):
        self.average = scorer.record_scorer == "average"
        self.weights = [1.0] * features if self.average else list(scorer.weights)
        self.square = scorer.record_scorer == "weighted-quadratic"
        self.least, self.total = 0.0 if self.average else scorer.min_weight_ratio * sum(self.weights), sum(self.weights)
        self.threshold, self.top, self.under, self.rest = threshold - SLACK, None, None, self.total

    def add(self, f: int, sims: np.ndarray, present: np.ndarray) -> None:
        weight = np.float32(self.weights[f])
        value = sims * sims if self.square else sims
        value = value if weight == 1 else value * weight
        self.rest -= self.weights[f]
        if self.top is None:
            self.top, self.under = value.copy(), None if self.average else present * weight
            return
        self.top += value
        if not self.average:
            self.under += present * weight

    def may(self) -> np.ndarray:
        """Pairs that may still score over the threshold; all of a weighted scorer before its last feature."""
        if self.average:
            return self.top > np.float32(self.threshold * self.total - max(self.rest, 0))
        if self.rest > 1e-9:
            return np.ones(self.top.shape, dtype=bool)
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.top / np.maximum(self.under, np.float32(self.least)) > np.float32(self.threshold)


def lacking(
    trackers: DataFrame, records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig, scorer: RecordScorerConfig,
) -> list[np.ndarray]:
    """What each feature lacks in the pairs of SAMPLE trackers and records, picked by hash; absent ones lack 2."""
    names = schema.names
    left = trackers.orderBy(F.xxhash64("tracker_id"), "tracker_id").limit(SAMPLE).select(*(memory_name(i) for i in range(len(names)))).collect()
    right = records.orderBy(F.xxhash64("record_idx"), "record_idx").limit(SAMPLE).select(*names).collect()
    side = RecordSide([[r[n] for r in right] for n in names], [f.dtype is ElementType.MultiStrings for f in schema.fields])
    power = 2 if scorer.record_scorer == "weighted-quadratic" else 1
    found = [side.similarity(i, [r[memory_name(i)] for r in left], metric) for i in range(len(names))]
    return [np.where(present, 1 - values.astype(np.float64) ** power, 2.0) for values, present in found]


def nested_loop(
    trackers: DataFrame, records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig, scorer: RecordScorerConfig, threshold: float | None,
) -> DataFrame:
    """(tracker_id, record_idx, distances) of all pairs that may score over ``threshold``; of all pairs without one.

    ``records``, few enough (counted before), go to every task; a batch of
    trackers computes its distinct words against the frame's once and gives out
    only the pairs that count. For more records see ``score_pairs``.
    """
    names = schema.names
    rows = records.select("record_idx", *names).orderBy("record_idx").collect()
    multi = [f.dtype is ElementType.MultiStrings for f in schema.fields]
    shared = records.sparkSession.sparkContext.broadcast((
        np.array([r.record_idx for r in rows], dtype=np.int64), RecordSide([[r[n] for r in rows] for n in names], multi),
        [pa.array([r[n] for r in rows], pa.list_(pa.string()) if lists else pa.string()) for n, lists in zip(names, multi, strict=True)],
    ))
    step = max(1, min(512, (1 << 22) // max(1, len(rows))))

    def by_bounds(part: pa.RecordBatch, side: RecordSide, order: list[int]):
        """What ``met`` gives, where bounds of similarities leave few pairs to look at one by one; None where they don't."""
        memories = [part[memory_name(f)].to_pylist() for f in range(len(names))]
        exact = [f for f in order if len(side.texts[f]) < MANY_WORDS]
        rest = [f for f in order if f not in exact]
        bounds = [side.bounds(f, memories[f]) for f in rest]
        if not rest or None in bounds:
            return None
        known = {f: side.similarity(f, memories[f], metric) for f in exact}
        least = np.float32((threshold - SLACK) * len(order))
        row, kept, count, most = np.empty(len(side.lengths[0]), dtype=np.float32), [], 0, [[] for _ in rest]
        for i in range(len(part)):
            row[:] = 0
            for values, _ in known.values():
                row += values[i]
            rows = [of(i) for of in bounds]
            for one in rows:
                row += one
            kept.append(np.flatnonzero(row > least))
            for of, one in zip(most, rows, strict=True):
                of.append(one[kept[-1]])
            count += len(kept[-1])
            if count > (i + 1) * len(row) * BOUNDED and (i + 1) * len(row) > FEW:
                return None
        t, r = np.repeat(np.arange(len(kept)), [len(one) for one in kept]), np.concatenate([np.zeros(0, dtype=np.int64), *kept])
        sims, present = ({f: known[f][i][t, r] for f in exact} for i in range(2))
        left = {f: np.concatenate([np.zeros(0, dtype=np.float32), *of]) for f, of in zip(rest, most, strict=True)}
        for f in rest:
            found = side.similarity_of(f, memories[f], metric, t, r)
            if found is None:
                return None
            sims[f], present[f] = found
            left.pop(f)
            top = sum(np.where(present[g], sims[g], np.float32(0)) for g in sims) + sum(left.values())
            open_ = top > least
            t, r = t[open_], r[open_]
            sims, present, left = ({g: v[open_] for g, v in of.items()} for of in (sims, present, left))
        every = range(len(names))
        return t, r, [sims[f] for f in every], [present[f] for f in every]

    def met(part: pa.RecordBatch, side: RecordSide, cells: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(trackers, records, similarities, present) of the pairs of a batch that may score over the threshold."""
        if threshold is None:
            every = [side.similarity(f, part[memory_name(f)].to_pylist(), metric) for f in range(len(names))]
            t, r = (v.reshape(-1) for v in np.indices(every[0][0].shape))
            return t, r, [s.reshape(-1) for s, _ in every], [p.reshape(-1) for _, p in every]
        order = sorted(range(len(names)), key=side.cost)
        few = by_bounds(part, side, order) if scorer.record_scorer == "average" and bounded(metric) else None
        if few is not None:
            return few
        found, bound = {}, Bound(scorer, len(names), threshold)
        for k, f in enumerate(order):
            found[f] = side.similarity(f, part[memory_name(f)].to_pylist(), metric)
            bound.add(f, *found[f])
            last = k + 1 == len(order)
            if last or bound.average:
                may = bound.may()
                if last or np.count_nonzero(may) < may.size * SPARSE:
                    break
        t, r = np.nonzero(may)
        sims = {f: s[t, r] for f, (s, _) in found.items()}
        present = {f: p[t, r] for f, (_, p) in found.items()}
        for f in order[len(found):]:
            # few pairs are left: pair by pair
            each = [_feature(part[memory_name(f)].take(pa.array(t[at : at + FEW])), cells[f].take(pa.array(r[at : at + FEW])), multi[f], metric) for at in range(0, len(t), FEW)]
            sims[f] = np.concatenate([np.zeros(0, dtype=np.float32), *(s for s, _ in each)])
            present[f] = np.concatenate([np.zeros(0, dtype=bool), *(p for _, p in each)])
            bound.top = sum(np.where(present[g], sims[g], np.float32(0)) for g in sims)
            bound.rest -= 1.0
            kept = bound.may()
            t, r = t[kept], r[kept]
            sims, present = ({g: v[kept] for g, v in of.items()} for of in (sims, present))
        every = range(len(names))
        return t, r, [sims[f] for f in every], [present[f] for f in every]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, side, cells = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                t, r, sims, present = met(part, side, cells)
                for a in range(0, len(t), GIVEN):
                    b = a + GIVEN
                    values, missing = np.stack([s[a:b] for s in sims], axis=1).reshape(-1), ~np.stack([p[a:b] for p in present], axis=1).reshape(-1)
                    distances = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(t[a:b]) + 1) * len(names), pa.int32()), pa.array(values, pa.float32(), mask=missing)
                    )
                    yield pa.RecordBatch.from_arrays(
                        [part["tracker_id"].take(pa.array(t[a:b])), pa.array(ids[r[a:b]]), distances], ["tracker_id", "record_idx", "distances"]
                    )

    return _dealt(trackers, schema).mapInArrow(run, "tracker_id long, record_idx long, distances array<float>")


def nested_rows(
    trackers: DataFrame, records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig, scorer: RecordScorerConfig, threshold: float, best: bool = False,
) -> DataFrame:
    """``nested_loop`` where ``ScoredRecords`` have trees: exact rows take less there than bounds do.

    With ``best`` only each tracker's best record of these, ties to the smaller.
    """
    shared, names = _shared_records(records, schema, metric), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        of_rows, kept, step = RowScorer(scorer, side.has), [{} for _ in names], _step(len(side.ids))
        least = np.float32(threshold - SLACK)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                every = [side.rows(f, part[memory_name(f)].to_pylist(), kept[f]) for f in range(len(names))]
                t, r, sims, lacking = [], [], [[] for _ in names], [[] for _ in names]
                for i in range(part.num_rows):
                    rows = [row(i) for row in every]
                    values = of_rows.of(rows)
                    some = np.flatnonzero(values > least)
                    if best and len(some):
                        some = some[values[some] == values[some].max()]
                        some = some[[np.argmin(side.ids[some])]]
                    t.append(np.full(len(some), i))
                    r.append(some)
                    for f, row in enumerate(rows):
                        sims[f].append(np.zeros(len(some), dtype=np.float32) if row is None else row[some])
                        lacking[f].append(np.ones(len(some), dtype=bool) if row is None else ~side.has[f][some])
                t, r = np.concatenate(t), np.concatenate(r)
                sims, lacking = (np.stack([np.concatenate(v) for v in of], axis=1) for of in (sims, lacking))
                for a in range(0, len(t), GIVEN):
                    b = min(len(t), a + GIVEN)
                    distances = pa.ListArray.from_arrays(
                        pa.array(np.arange(b - a + 1) * len(names), pa.int32()), pa.array(sims[a:b].reshape(-1), pa.float32(), mask=lacking[a:b].reshape(-1))
                    )
                    yield pa.RecordBatch.from_arrays([part["tracker_id"].take(pa.array(t[a:b])), pa.array(side.ids[r[a:b]]), distances], ["tracker_id", "record_idx", "distances"])

    return _dealt(trackers, schema).mapInArrow(run, "tracker_id long, record_idx long, distances array<float>")


def _shared_records(records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig):
    """``ScoredRecords`` of few enough records, for every task."""
    rows = records.select("record_idx", *schema.names).orderBy("record_idx").collect()
    multi = [f.dtype is ElementType.MultiStrings for f in schema.fields]
    ids = np.array([r.record_idx for r in rows], dtype=np.int64)
    return records.sparkSession.sparkContext.broadcast(ScoredRecords(ids, [[r[n] for r in rows] for n in schema.names], multi, metric))


def _step(records: int) -> int:
    """Trackers whose edits are made at once."""
    return max(8, min(512, (1 << 22) // max(1, records)))


def _dealt(trackers: DataFrame, schema: RecordSchema) -> DataFrame:
    tasks = trackers.sparkSession.sparkContext.defaultParallelism * ROUNDS
    return trackers.select("tracker_id", *(memory_name(i) for i in range(len(schema.names)))).repartition(tasks, "tracker_id")


def nested_scores(
    trackers: DataFrame, records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig, scorer: RecordScorerConfig, digits: int,
) -> DataFrame:
    """(tracker_id, record_idx, score double) of all pairs, rounded to so many digits; ``records`` go to every task as in ``nested_loop``.

    Python gives out lists of LISTED scores in units of the last digit, null for NaN; the JVM divides them, and counts
    records from a list's first where their numbers follow each other: less is handed over than a row a pair.
    """
    if digits > DIGITS:
        raise ValueError(f"scores are single-precision, so up to {DIGITS} digits")
    shared, names = _shared_records(records, schema, metric), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, n = shared.value, len(shared.value.ids)
        of_rows, kept = RowScorer(scorer, side.has), [{} for _ in names]
        back = np.argsort(side.ids, kind="stable")
        # trackers that are given out at once
        starts, step, given = np.arange(0, n, LISTED), _step(n), max(1, LISTS // max(1, n))
        ids = side.ids[back]
        follow = n > 0 and int(ids[-1]) - int(ids[0]) == n - 1
        firsts, every_id = np.tile(ids[starts], given), None if follow else pa.array(np.tile(ids, given))
        for batch in batches if n else ():
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                every = [side.rows(f, part[memory_name(f)].to_pylist(), kept[f]) for f in range(len(names))]
                for a in range(0, part.num_rows, given):
                    b = min(part.num_rows, a + given)
                    units, lacks = np.empty((b - a, n), dtype=np.int32), None
                    for t in range(a, b):
                        values = of_rows.of([row(t) for row in every])
                        if np.isnan(values.min()):
                            lacks = np.zeros(units.shape, dtype=bool) if lacks is None else lacks
                            lacks[t - a] = np.isnan(values)[back]
                            values[np.isnan(values)] = 0
                        units[t - a] = last_digits(values, digits).astype(np.int32).take(back)
                    ends = pa.array(np.append((np.arange(b - a)[:, None] * n + starts).reshape(-1), (b - a) * n), pa.int32())
                    scores = pa.array(units.reshape(-1), mask=None if lacks is None else lacks.reshape(-1))
                    lists = (b - a) * len(starts)
                    yield pa.RecordBatch.from_arrays([
                        part["tracker_id"].take(pa.array(np.repeat(np.arange(a, b), len(starts)))), pa.array(firsts[:lists]),
                        pa.nulls(lists, pa.list_(pa.int64())) if follow else pa.ListArray.from_arrays(ends, every_id.slice(0, (b - a) * n)),
                        pa.ListArray.from_arrays(ends, scores),
                    ], ["tracker_id", "first", "records", "scores"])

    found = _dealt(trackers, schema).mapInArrow(run, "tracker_id long, first long, records array<long>, scores array<int>")
    return found.select("tracker_id", "first", "records", F.posexplode("scores").alias("at", "units")).select(
        "tracker_id", F.coalesce(F.get("records", "at"), F.col("first") + F.col("at")).alias("record_idx"),
        F.coalesce(F.col("units") / F.lit(10.0**digits), F.lit(float("nan"))).alias("score"),
    )


def ranked_scores(
    trackers: DataFrame, records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig, scorer: RecordScorerConfig, threshold: float, digits: int,
) -> DataFrame:
    """(tracker_id, record_idx, score double, rank int): all pairs that score over ``threshold``, their scores rounded to so many digits.

    Ranks are those of ``rank_records``: a tracker's records, best rounded score
    first, ties to the smaller. Up to RANKED records all blocks of these go to
    every task, which ranks a tracker's records where it scores them: no pair
    is shuffled. Beyond, pairs are shuffled and sorted.
    """
    if digits > DIGITS:
        raise ValueError(f"scores are single-precision, so up to {DIGITS} digits")
    scorer.check(len(schema.fields))
    m, names = records.count(), schema.names
    if m > RANKED:
        found = score_pairs(trackers, records, schema, metric, scorer, threshold)
        found = found.withColumn("score", F.round(F.col("score").cast("double"), digits))
        return rank_records(found).select("tracker_id", "record_idx", "score", F.col("record_rank").alias("rank"))
    shared = [_shared_records(some, schema, metric) for some in _blocks(records, m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [one.value for one in shared]
        ids = np.sort(np.concatenate([side.ids for side in sides]))
        places = [np.searchsorted(ids, side.ids) for side in sides]
        scorers, kept = [RowScorer(scorer, side.has) for side in sides], [[{} for _ in names] for _ in sides]
        step, least = _step(len(ids)), np.float32(threshold)
        for batch in batches if len(ids) else ():
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                memories, keys = [part[memory_name(f)].to_pylist() for f in range(len(names))], [[] for _ in range(part.num_rows)]
                for side, place, of_rows, known in zip(sides, places, scorers, kept, strict=True):
                    every = [side.rows(f, memories[f], known[f]) for f in range(len(names))]
                    for t, mine in enumerate(keys):
                        values = of_rows.of([row(t) for row in every])
                        some = np.flatnonzero(values > least)
                        # better scores are smaller, then smaller records are
                        mine.append((TOP - last_digits(values[some], digits).astype(np.int64) << 32) + place[some])
                yield from given(part["tracker_id"], [np.sort(np.concatenate(mine)) for mine in keys], ids)

    def given(trackers: pa.Array, keys: list[np.ndarray], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lists of LISTED records, as many trackers at once as LISTS takes."""
        sizes = np.array([len(key) for key in keys], dtype=np.int64)
        for begin, end in _runs(np.cumsum(sizes), LISTS):
            some, mine = np.concatenate(keys[begin:end]), sizes[begin:end]
            firsts = [np.arange(0, n, LISTED) for n in mine.tolist()]
            lists = [len(first) for first in firsts]
            ends = pa.array(np.append(np.concatenate(firsts) + np.repeat(np.cumsum(mine) - mine, lists), len(some)), pa.int32())
            which = np.repeat(np.arange(begin, end), lists)
            yield pa.RecordBatch.from_arrays([
                trackers.take(pa.array(which)), pa.array(np.concatenate(firsts) + 1, pa.int32()),
                pa.ListArray.from_arrays(ends, pa.array(ids[some & 0xFFFFFFFF])),
                pa.ListArray.from_arrays(ends, pa.array((TOP - (some >> 32)).astype(np.int32))),
            ], ["tracker_id", "first", "records", "scores"])

    found = _dealt(trackers, schema).mapInArrow(run, "tracker_id long, first int, records array<long>, scores array<int>")
    return found.select("tracker_id", "first", "records", F.posexplode("scores").alias("at", "units")).select(
        "tracker_id", F.get("records", "at").alias("record_idx"), (F.col("units") / F.lit(10.0**digits)).alias("score"), (F.col("first") + F.col("at")).alias("rank"),
    )


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (begin, end) of things that lie up to ``ends``, each of one or of as many as have ``most`` together."""
    begin = 0
    while begin < len(ends):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, end
        begin = end


def _blocks(records: DataFrame, m: int) -> list[DataFrame]:
    """``m`` records in blocks that may go to every task."""
    blocks = max(1, -(-m // BROADCAST_RECORDS))
    part = F.pmod(F.xxhash64("record_idx"), F.lit(blocks))
    return [records.where(part == i) for i in range(blocks)]


def _scan(
    trackers: DataFrame, records: DataFrame, m: int, schema: RecordSchema, metric: DistanceMetricConfig, scorer: RecordScorerConfig, threshold: float | None,
    best: bool = False,
) -> DataFrame:
    """``nested_loop`` over ``m`` records in blocks; with ``best`` a block may give only each tracker's best record."""
    if metric.metric == "lv" and threshold is not None:
        return reduce(DataFrame.union, [nested_rows(trackers, some, schema, metric, scorer, threshold, best) for some in _blocks(records, m)])
    return reduce(DataFrame.union, [nested_loop(trackers, some, schema, metric, scorer, threshold) for some in _blocks(records, m)])


def all_similarities(trackers: DataFrame, records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig) -> DataFrame:
    """(tracker_id, record_idx, distances) of all trackers and all records, whatever they score."""
    return _scan(trackers, records, records.count(), schema, metric, RecordScorerConfig(), None)


def all_scores(trackers: DataFrame, records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig, scorer: RecordScorerConfig, digits: int) -> DataFrame:
    """(tracker_id, record_idx, score double) of all trackers and all records, rounded to so many digits where they are computed."""
    scorer.check(len(schema.fields))
    found = [nested_scores(trackers, some, schema, metric, scorer, digits) for some in _blocks(records, records.count())]
    return reduce(DataFrame.union, found)


def scans(metric: DistanceMetricConfig, pairs: int) -> bool:
    """Whether so many pairs are scanned by tables of words."""
    return metric.metric in QUICK_METRICS and SCANNED[0] < pairs <= SCANNED[1]


def score_pairs(
    trackers: DataFrame, records: DataFrame, schema: RecordSchema, metric: DistanceMetricConfig,
    scorer: RecordScorerConfig, threshold: float, all_pairs: int = ALL_PAIRS, words: WordPairs | None = None, counts: dict[str, int] | None = None,
    best: bool = False,
) -> DataFrame:
    """(tracker_id, record_idx, score, distances) of all pairs that score over ``threshold``.

    With ``best`` pairs may be left off, but never a tracker's best record (the
    smallest of them): a scan of ``lv`` gives one pair a tracker and block then.

    Few pairs: all trackers meet all records. Many: they do too, in blocks of
    BROADCAST_RECORDS, where the metric has quick tables of words: a pair costs
    some tens of nanoseconds there, less than the joins of candidates. Else, and
    beyond SCANNED: the candidates that the threshold leaves (see
    ``candidates``). Where it leaves all, as one of 0 does, blocks again.

    With ``words`` (of ``metric``) pairs of any number are candidates, if the
    threshold bounds them, and their similarities are joined from that table.
    ``counts`` takes the pairs that could meet, those that met, and the word
    pairs that were new (0 without a table); they are counts of stored rows, so
    a task that was run again adds nothing.
    """
    n, m = trackers.count(), records.count()
    pairs, scanned = None, scans(metric, n * m)
    if not scanned and (words is not None or n * m > all_pairs):
        pairs = candidates(trackers, records, schema, metric, scorer, threshold, lacking(trackers, records, schema, metric, scorer))
    elif scanned and words is not None and 0 < threshold < 1:
        pairs = _scan(trackers, records, m, schema, metric, scorer, threshold, best).select("tracker_id", "record_idx").join(trackers, "tracker_id").join(records, "record_idx")
    met, new = n * m, 0
    if pairs is not None and (words is not None or counts is not None):
        pairs = stored(pairs.select("tracker_id", "record_idx", *(memory_name(i) for i in range(len(schema.fields))), *schema.names), "candidates")
        met = pairs.count()
    if pairs is not None and words is not None:
        found, new = joined_similarities(pairs, schema, words)
    elif pairs is not None:
        found = pair_similarities(pairs, schema, metric)
    else:
        found = _scan(trackers, records, m, schema, metric, scorer, threshold, best)
    if counts is not None:
        counts.update(possible=n * m, met=met, new_words=new)
    by_feature = [F.get("distances", i) for i in range(len(schema.fields))]
    return (
        found.withColumn("score", score(scorer, by_feature)).where(interesting(F.col("score"), threshold))
        .select("tracker_id", "record_idx", "score", "distances")
    )


def rank_records(scores: DataFrame) -> DataFrame:
    """``scores`` with record_rank: a tracker's records, best first, ties to the smaller record."""
    return scores.withColumn("record_rank", F.row_number().over(Window.partitionBy("tracker_id").orderBy(F.desc("score"), "record_idx")))


def rank_trackers(scores: DataFrame) -> DataFrame:
    """``scores`` with tracker_rank: a record's trackers, best first, ties to the smaller tracker."""
    return scores.withColumn("tracker_rank", F.row_number().over(Window.partitionBy("record_idx").orderBy(F.desc("score"), "tracker_id")))
