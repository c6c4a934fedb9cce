"""Word similarities, 1 for equal words.

Pairs are computed in batches: the dynamic programme runs over (i, j) in Python
and over all pairs of a batch in numpy, so a pair costs well under a
microsecond per cell row. Plain Levenshtein over one-character graphemes has a
Catalyst form too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinthread.config import DistanceMetricConfig
from kinthread.functions.tables import Prefixes, Texts
from kinthread.functions.words import edit_script, graphemes

#: Cells over the diagonal.
FAR = 1 << 20
#: Pairs of one dynamic programme.
BATCH = 1 << 15
#: Up to so many pairs plain Python is faster than numpy.
FEW = 32


class Lexicon:
    """Distinct words as one padded matrix of grapheme numbers."""

    def __init__(self, words: Sequence[Sequence[str]]):
        self.words = words
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        numbers: dict[str, int] = {}
        self.matrix = np.full((len(words), max(1, self.lengths.max(initial=0))), -1, dtype=np.int32)
        for row, word in zip(self.matrix, words, strict=True):
            row[: len(word)] = [numbers.setdefault(g, len(numbers)) for g in word]


class Coded:
    """Pairs of words as two matrices, cut to their longest words."""

    def __init__(self, lexicon: Lexicon, left: np.ndarray, right: np.ndarray):
        self.la, self.lb = lexicon.lengths[left], lexicon.lengths[right]
        self.a = lexicon.matrix[left, : max(1, self.la.max(initial=0))]
        self.b = lexicon.matrix[right, : max(1, self.lb.max(initial=0))]


def _by_length(lexicon: Lexicon, left: np.ndarray, right: np.ndarray, compute, columns: int) -> np.ndarray:
    """``compute`` over batches of pairs of like lengths; int64 (pairs, columns)."""
    if len(left) <= FEW:
        one = {_full: _full_of_one, _triangle: _triangle_of_one, _scripts: _script_of_one}[compute]
        found = [one(lexicon.words[a], lexicon.words[b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
        return np.array(found, dtype=np.int64).reshape(len(left), columns)
    out = np.zeros((len(left), columns), dtype=np.int64)
    longest = np.maximum(lexicon.lengths[left], lexicon.lengths[right])
    order = np.argsort(longest, kind="stable")
    ranked = longest[order]
    at = 0
    while at < len(order):
        # up to half as long again, so that padding stays small
        end = int(np.searchsorted(ranked, max(8, ranked[at] * 3 // 2), side="right"))
        part = order[at : min(end, at + BATCH)]
        out[part] = compute(Coded(lexicon, left[part], right[part])).reshape(len(part), columns)
        at += len(part)
    return out


def _full(c: Coded) -> np.ndarray:
    """Levenshtein."""
    n, width = len(c.la), c.b.shape[1]
    row = np.tile(np.arange(width + 1, dtype=np.int32), (n, 1)).T.copy()
    out = np.take_along_axis(row, c.lb[None, :], 0)[0]
    for i in range(1, c.a.shape[1] + 1):
        new = np.empty_like(row)
        new[0] = i
        for j in range(1, width + 1):
            different = c.a[:, i - 1] != c.b[:, j - 1]
            new[j] = np.minimum(row[j - 1] + different, np.minimum(row[j], new[j - 1]) + 1)
        row = new
        out = np.where(c.la == i, np.take_along_axis(row, c.lb[None, :], 0)[0], out)
    return out


def _triangle(c: Coded) -> np.ndarray:
    """(edits, longest common run) of the programme below the diagonal; left words must not be shorter."""
    n, width = len(c.la), c.b.shape[1]
    row = np.full((width + 1, n), FAR, dtype=np.int32)
    run = np.zeros((width + 1, n), dtype=np.int32)
    row[0] = 0
    longest = np.zeros(n, dtype=np.int32)
    out = np.zeros(n, dtype=np.int32)  # both empty
    for i in range(1, c.a.shape[1] + 1):
        new, new_run = np.full_like(row, FAR), np.zeros_like(run)
        new[0] = i
        alive = i <= c.la
        for j in range(1, min(i, width) + 1):
            same = c.a[:, i - 1] == c.b[:, j - 1]
            new[j] = np.where(same, row[j - 1], np.minimum(np.minimum(row[j - 1], row[j]), new[j - 1]) + 1)
            new_run[j] = np.where(same, run[j - 1] + 1, 0)
            longest = np.where(alive & (j <= c.lb), np.maximum(longest, new_run[j]), longest)
        row, run = new, new_run
        out = np.where(c.la == i, np.take_along_axis(row, c.lb[None, :], 0)[0], out)
    return np.stack([out, longest], axis=1)


def _scripts(c: Coded) -> np.ndarray:
    """(substitutions, deletions, additions) on the script that prefers add, then del, then sub."""
    n, width = len(c.la), c.b.shape[1]
    row = np.zeros((width + 1, 4, n), dtype=np.int32)  # cost, sub, del, add
    row[:, 0] = row[:, 3] = np.arange(width + 1)[:, None]
    pick = np.arange(n)
    out = row[c.lb, :, pick]
    for i in range(1, c.a.shape[1] + 1):
        new = np.empty_like(row)
        new[0] = 0
        new[0, 0] = new[0, 2] = i
        for j in range(1, width + 1):
            sub, remove, insert = row[j - 1], row[j], new[j - 1]
            by_sub = (sub[0] < remove[0]) & (sub[0] < insert[0])
            by_remove = ~by_sub & (remove[0] < insert[0])
            base = np.where(by_sub, sub, np.where(by_remove, remove, insert)).copy()
            base[0] += 1
            base[1] += by_sub
            base[2] += by_remove
            base[3] += ~by_sub & ~by_remove
            new[j] = np.where(c.a[:, i - 1] == c.b[:, j - 1], row[j - 1], base)
        row = new
        out = np.where((c.la == i)[:, None], row[c.lb, :, pick], out)
    return out[:, 1:]


def _full_of_one(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before if x == y else 1 + min(before, row[j], row[j - 1])
    return row[-1]


def _triangle_of_one(a, b) -> tuple[int, int]:
    row, run, longest = [0] + [FAR] * len(b), [0] * (len(b) + 1), 0
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        before_run = 0
        for j, y in enumerate(b[:i], 1):
            here, here_run = row[j], run[j]
            if x == y:
                row[j], run[j] = before, before_run + 1
                longest = max(longest, run[j])
            else:
                row[j], run[j] = 1 + min(before, here, row[j - 1]), 0
            before, before_run = here, here_run
    return row[-1], longest


def _script_of_one(a, b) -> list[int]:
    kinds = [kind for kind, _ in edit_script(a, b)]
    return [kinds.count("sub"), kinds.count("del"), kinds.count("add")]


def _triangles(lexicon: Lexicon, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(edits, longest run) with the longer word first; words of one length stay in order."""
    swap = lexicon.lengths[left] < lexicon.lengths[right]
    return _by_length(lexicon, np.where(swap, right, left), np.where(swap, left, right), _triangle, 2)


def _pieces(word: Sequence[str], separator: str) -> list[Sequence[str]]:
    out: list[list[str]] = [[]]
    for g in word:
        if g == separator:
            out.append([])
        else:
            out[-1].append(g)
    return [tuple(p) for p in out if p]


def _edits(metric: DistanceMetricConfig, lexicon: Lexicon, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """float32 edits of pairs of the lexicon's words, after the metric's weights."""
    if metric.metric == "lv":
        return _by_length(lexicon, left, right, _full, 1)[:, 0].astype(np.float32)
    if metric.metric == "lv_edit":
        counts = _by_length(lexicon, left, right, _scripts, 3).astype(np.float32)
        weights = np.array(metric.lv_edit_weights, dtype=np.float32)
        return counts[:, 0] * weights[0] + counts[:, 1] * weights[1] + counts[:, 2] * weights[2]
    if metric.metric == "lv_multiword":
        return _multiword_edits(lexicon, left, right, metric.lv_multiword_separator)
    found = _triangles(lexicon, left, right).astype(np.float32)
    if metric.metric == "lv_opti":
        return found[:, 0]
    return np.maximum(found[:, 0] - found[:, 1] * np.float32(metric.lv_substring_weight), np.float32(0))


def _multiword_edits(lexicon: Lexicon, left: np.ndarray, right: np.ndarray, separator: str) -> np.ndarray:
    """Per position where both have as many words (over one), scaled by the imperfect share and truncated."""
    pieces = [_pieces(w, separator) for w in lexicon.words]
    counts = np.array([len(p) for p in pieces], dtype=np.int64)
    by_part = (counts[left] == counts[right]) & (counts[left] > 1)
    out = np.zeros(len(left), dtype=np.float32)
    whole = np.flatnonzero(~by_part)
    if len(whole):
        out[whole] = _triangles(lexicon, left[whole], right[whole])[:, 0]
    mine = np.flatnonzero(by_part)
    if len(mine):
        place: dict[Sequence[str], int] = {}
        numbers = [[place.setdefault(p, len(place)) for p in parts] for parts in pieces]
        a = np.array([i for k in left[mine].tolist() for i in numbers[k]], dtype=np.int64)
        b = np.array([i for k in right[mine].tolist() for i in numbers[k]], dtype=np.int64)
        each = _triangles(Lexicon(list(place)), a, b)[:, 0]
        n = counts[left[mine]]
        begins = np.cumsum(n) - n
        total, perfect = np.add.reduceat(each, begins), np.add.reduceat(each == 0, begins, dtype=np.int64)
        factor = np.float32(1) - perfect.astype(np.float32) / n.astype(np.float32)
        out[mine] = np.trunc(total.astype(np.float32) * factor)
    return out


def _numbered(left: Sequence[str], right: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    place: dict[str, int] = {}
    a = np.array([place.setdefault(w, len(place)) for w in left], dtype=np.int64)
    b = np.array([place.setdefault(w, len(place)) for w in right], dtype=np.int64)
    return list(place), a, b


def edits(metric: DistanceMetricConfig, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """float32 edits of each pair, after the metric's weights."""
    words, a, b = _numbered(left, right)
    return _edits(metric, Lexicon([graphemes(w) for w in words]), a, b)


def _similarities(metric: DistanceMetricConfig, words: Sequence[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    size = np.array([len(w.encode()) for w in words], dtype=np.float32)
    size = np.maximum(size[left], size[right])
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.float32(1) - _edits(metric, Lexicon([graphemes(w) for w in words]), left, right) / size
        if metric.use_sigmoid:
            out = np.float32(1) / (np.float32(1) + np.exp(-(np.float32(8) * out - np.float32(4))))
    return out.astype(np.float32)


def similarities(metric: DistanceMetricConfig, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """float32 ``1 - edits / bytes of the longer word``; NaN for two empty words."""
    if not len(left):
        return np.zeros(0, dtype=np.float32)
    return _similarities(metric, *_numbered(left, right))


def similarity_table(metric: DistanceMetricConfig, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """float32 similarities of all left words to all right words."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), dtype=np.float32)
    words, a, b = _numbered(left, right)
    return _similarities(metric, words, np.repeat(a, len(b)), np.tile(b, len(a))).reshape(len(a), len(b))


def _table_edits(metric: DistanceMetricConfig, left: Sequence[Sequence[str]], texts: Texts) -> np.ndarray | None:
    """Edits of all left words to all of ``texts``, after the metric's weights; None where there is no quick form."""
    if metric.metric == "lv":
        return texts.levenshtein(left)
    if metric.metric == "lv_opti":
        found = texts.triangle(left)
        return None if found is None else found[0]
    if metric.metric == "lv_substring":
        found = texts.triangle(left, runs=True)
        if found is None:
            return None
        return np.maximum(found[0].astype(np.float32) - found[1].astype(np.float32) * np.float32(metric.lv_substring_weight), np.float32(0))
    if metric.metric == "lv_multiword":
        return _multiword_table(left, texts, metric.lv_multiword_separator)
    return None


def _multiword_table(left: Sequence[Sequence[str]], texts: Texts, separator: str) -> np.ndarray | None:
    """``_multiword_edits`` of all left words to all of ``texts``, by numbers of parts on either side."""
    out = np.zeros((len(left), len(texts)), dtype=np.float32)
    pieces = [_pieces(w, separator) for w in left]
    mine = np.array([len(p) for p in pieces], dtype=np.int64)
    for n, columns, words, parts, places in texts.by_parts(separator, _pieces):
        for k in np.unique(mine).tolist():
            rows = np.flatnonzero(mine == k)
            if k != n or n < 2:
                found = words.triangle([left[i] for i in rows.tolist()])
                if found is None:
                    return None
                out[np.ix_(rows, columns)] = found[0]
                continue
            place: dict[Sequence[str], int] = {}
            numbers = np.array([[place.setdefault(p, len(place)) for p in pieces[i]] for i in rows.tolist()])
            found = parts.triangle(list(place))
            if found is None:
                return None
            total = np.zeros((len(rows), len(columns)), dtype=np.int64)
            perfect = np.zeros(total.shape, dtype=np.int64)
            for at in range(n):
                each = found[0][numbers[:, at]][:, places[:, at]]
                total += each
                perfect += each == 0
            factor = np.float32(1) - perfect.astype(np.float32) / np.float32(n)
            out[np.ix_(rows, columns)] = np.trunc(total.astype(np.float32) * factor)
    return out


def quick_table(metric: DistanceMetricConfig, left: Sequence[str], texts: Texts) -> np.ndarray | None:
    """``similarity_table`` of left words to prepared ones, in their order; None where there is no quick form."""
    found = _table_edits(metric, [graphemes(w) for w in left], texts)
    if found is None:
        return None
    size = np.maximum(np.array([len(w.encode()) for w in left], dtype=np.int64)[:, None], texts.bytes[None]).astype(np.float32)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.float32(1) - found.astype(np.float32) / size
        if metric.use_sigmoid:
            out = np.float32(1) / (np.float32(1) + np.exp(-(np.float32(8) * out - np.float32(4))))
    return out.astype(np.float32, copy=False)


def quick_rows(metric: DistanceMetricConfig, left: Sequence[str], words: Prefixes) -> Callable[[int], np.ndarray]:
    """What gives a left word's row (by its number) of ``similarity_table``, in the order of ``words``."""
    found = words.levenshtein([graphemes(w) for w in left]) if metric.metric == "lv" else None
    if found is None:
        table = similarity_table(metric, left, words.words)
        return lambda i: table[i]
    sizes: dict[int, np.ndarray] = {}

    def row(i: int) -> np.ndarray:
        n = len(left[i].encode())
        if n not in sizes:
            sizes[n] = np.maximum(n, words.bytes).astype(np.float32)
        out = found[i].astype(np.float32)
        with np.errstate(invalid="ignore", divide="ignore"):
            np.divide(out, sizes[n], out=out)
            np.subtract(np.float32(1), out, out=out)
            if metric.use_sigmoid:
                out = np.float32(1) / (np.float32(1) + np.exp(-(np.float32(8) * out - np.float32(4))))
        return out

    return row


def pairs_table(metric: DistanceMetricConfig, left: Sequence[str], texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """``quick_table`` of single pairs: left words ``a`` and texts ``b`` by number; None where there is no quick form."""
    split = [graphemes(w) for w in left]
    found = None
    if bounded(metric):
        found = texts.levenshtein_of(split, a, b) if metric.metric == "lv" else texts.triangle_of(split, a, b)
    if found is None:
        return None
    size = np.maximum(np.array([len(w.encode()) for w in left], dtype=np.int64)[a], texts.bytes[b]).astype(np.float32)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.float32(1) - found.astype(np.float32) / size


def bounded(metric: DistanceMetricConfig) -> bool:
    """Whether ``Texts.bounds`` are over the metric's similarities."""
    return metric.metric in ("lv", "lv_opti") and not metric.use_sigmoid


def character_table(left: Sequence[str], texts: Texts) -> np.ndarray:
    """``native_levenshtein`` of left words to prepared ones (by characters), in their order."""
    found = texts.levenshtein(left)
    if found is None:
        words, a, b = _numbered(left, texts.words)
        found = _by_length(Lexicon(words), np.repeat(a, len(b)), np.tile(b, len(a)), _full, 1).reshape(len(a), len(b))
    size = np.maximum(np.array([len(w.encode()) for w in left], dtype=np.int64)[:, None], texts.bytes[None]).astype(np.float32)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.float32(1) - found.astype(np.float32) / size


def similarity_udf(metric: DistanceMetricConfig):
    """float column function of two string columns; null if either is null."""

    @F.arrow_udf("float")
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = list(zip(left.to_pylist(), right.to_pylist(), strict=True))
        place = {p: i for i, p in enumerate(dict.fromkeys(p for p in pairs if None not in p))}
        values = similarities(metric, [a for a, _ in place], [b for _, b in place]).tolist()
        return pa.array([values[place[p]] if None not in p else None for p in pairs], pa.float32())

    return similarity


def sigmoid(value: Column) -> Column:
    return (1 / (1 + F.exp(-(8 * value - 4)))).cast("float")


def native_levenshtein(left: Column, right: Column, use_sigmoid: bool = False) -> Column:
    """``lv`` in Catalyst, for text whose graphemes are single characters."""
    size = F.greatest(F.octet_length(left), F.octet_length(right)).cast("float")
    value = (F.lit(1.0).cast("float") - (F.levenshtein(left, right).cast("float") / size).cast("float")).cast("float")
    # two empty words: 0 / 0
    value = F.when(size == 0, F.lit(float("nan")).cast("float")).otherwise(value)
    return sigmoid(value) if use_sigmoid else value


def multi_similarity(left: Column, right: Column, similarity) -> Column:
    """Mean over left words of the best right word, over the longer list's size.

    Null for null lists or no left word; 0 for no right word. ``similarity`` is
    a Catalyst function of two string columns. NaN loses against a number.
    """

    def best(word: Column) -> Column:
        values = F.transform(right, lambda other: similarity(word, other))
        numbers = F.filter(values, lambda v: ~F.isnan(v))
        return F.when(F.size(right) == 0, F.lit(0.0)).otherwise(
            F.coalesce(F.array_max(numbers), F.lit(float("nan")))
        ).cast("float")

    total = F.aggregate(left, F.lit(0.0).cast("float"), lambda acc, word: (acc + best(word)).cast("float"))
    value = (total / F.greatest(F.size(left), F.size(right)).cast("float")).cast("float")
    return F.when(left.isNotNull() & right.isNotNull() & (F.size(left) > 0), value)
