"""Tracker memories: which values stand for what a tracker has matched so far.

A memory is a pure function of the ordered history of non-null cells. A cell is
array<string>; a String cell has one element. The result is an array of such
elements.

A tracker doesn't keep its history but a *state* that takes cell after cell: the
distinct values with their numbers and first and last places (a tally), or one
tally for each sub-memory. That is all that modes and medians look at: of the
values of the highest count, the one that reached it first is the one whose
last place is earliest. Only ``bruteforce`` is the history itself. Counting
states are Catalyst expressions; medians and multi-word ones are Arrow UDFs
over tallies. ``memory_column`` takes a whole history at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinthread.config import DistanceMetricConfig, MemoryConfig
from kinthread.functions.similarity import similarities
from kinthread.functions.words import align, graphemes, median_word
from kinthread.schema import ElementType

CELLS = "array<array<string>>"
Cell = tuple[str, ...]


def most_frequent(history: Sequence) -> list:
    """All values tied at the highest count, first seen first."""
    counts: dict = {}
    for v in history:
        counts[v] = counts.get(v, 0) + 1
    most = max(counts.values(), default=0)
    return [v for v, n in counts.items() if n == most]


def median(history: Sequence[str]) -> list[str]:
    found = median_word(list(history))
    return [] if found is None else [found]


def multi_word(history: Sequence[Cell], strategy: str, metric: DistanceMetricConfig, threshold: float, compat: bool = False) -> list[Cell]:
    """One element: a word of every sub-memory, in order of creation.

    Each incoming word goes to the sub-memory whose word is most similar (the
    first of equals), if at least ``threshold``, or else begins one.
    ``compat`` sends every match to the first sub-memory.
    """
    subs: list[list[str]] = []
    words: list[str] = []
    stand_for = most_frequent if strategy == "mw-mostfrequent" else median
    for cell in history:
        for word in cell:
            best, at = 0.0, 0
            for i, value in enumerate(similarities(metric, [word] * len(words), words).tolist()):
                if value > best:
                    best, at = value, i
            if subs and best >= threshold:
                at = 0 if compat else at
                subs[at].append(word)
            else:
                at = len(subs)
                subs.append([word])
                words.append(word)
            words[at] = stand_for(subs[at])[0]
    return [tuple(words)] if history else []


def remember(memory: MemoryConfig, history: Sequence[Cell], dtype: ElementType = ElementType.String) -> list[Cell]:
    """The memory's elements for a history of cells."""
    strategy = memory.memory_strategy
    if strategy.startswith("mw-"):
        return multi_word(
            history, strategy, memory.multiword_distance_metric, memory.multiword_threshold_match,
            memory.compat_first_memory,
        )
    if strategy.startswith("ls-"):
        if not history:
            return []
        return remember(MemoryConfig(strategy[3:]), history[:-1], dtype) + [history[-1]]
    if strategy == "bruteforce":
        return list(history)
    if strategy == "mostfrequent":
        return most_frequent(history)
    # median: of words only
    return [(w,) for w in median([c[0] for c in history])] if dtype is ElementType.String else []


def memory_column(memory: MemoryConfig, history: Column, dtype: ElementType = ElementType.String) -> Column:
    """array<array<string>> memory of a history column."""
    strategy = memory.memory_strategy
    if strategy == "bruteforce":
        return history
    if strategy == "mostfrequent":
        return native_most_frequent(history)
    if strategy in ("ls-bruteforce", "ls-mostfrequent"):
        long = F.slice(history, 1, F.greatest(F.size(history) - 1, F.lit(0)))
        long = long if strategy == "ls-bruteforce" else native_most_frequent(long)
        return F.when(F.size(history) > 0, F.concat(long, F.slice(history, -1, 1))).otherwise(history)

    @F.pandas_udf(CELLS)
    def fold(values: pd.Series) -> pd.Series:
        return pd.Series([
            [list(c) for c in remember(memory, [tuple(c) for c in h], dtype)] if h is not None else None for h in values
        ])

    return fold(history)


def native_most_frequent(history: Column) -> Column:
    """Values of an array tied at the highest count, first seen first."""

    def counted(tally: Column, value: Column) -> Column:
        more = F.transform(tally, lambda t: F.when(t["value"].eqNullSafe(value), F.struct(t["value"].alias("value"), (t["n"] + 1).alias("n"))).otherwise(t))
        new = F.concat(tally, F.array(F.struct(value.alias("value"), F.lit(1).alias("n"))))
        return F.when(F.exists(tally, lambda t: t["value"].eqNullSafe(value)), more).otherwise(new).cast("array<struct<value:array<string>,n:int>>")

    tally = F.aggregate(history, F.array().cast("array<struct<value:array<string>,n:int>>"), counted)
    return F.transform(F.filter(tally, lambda t: t["n"] == F.array_max(F.transform(tally, lambda u: u["n"]))), lambda t: t["value"])


TALLY = "array<struct<value:array<string>,n:int,first:int,last:int>>"
STATE = f"struct<cells:{CELLS},tally:{TALLY},last:{CELLS},seen:int,subs:array<{TALLY}>>"
#: value, number, first and last place
Entry = tuple[Cell, int, int, int]
_TALLY_ARROW = pa.list_(pa.struct([("value", pa.list_(pa.string())), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))


def empty_state() -> Column:
    """The state before any cell."""
    return F.expr(f"cast(named_struct('cells', array(), 'tally', array(), 'last', array(), 'seen', 0, 'subs', array()) as {STATE})")


def _counted(tally: str, value: str, place: str) -> str:
    """SQL: ``tally`` with one more ``value``."""
    more = f"transform({tally}, e -> if(e.value <=> {value}, named_struct('value', e.value, 'n', e.n + 1, 'first', e.first, 'last', {place}), e))"
    new = f"concat({tally}, array(named_struct('value', {value}, 'n', 1, 'first', {place}, 'last', {place})))"
    return f"if(exists({tally}, e -> e.value <=> {value}), {more}, {new})"


def with_cell(memory: MemoryConfig, state: str, cell: str) -> Column:
    """The state after one more cell; ``state`` and ``cell`` are SQL."""
    strategy = memory.memory_strategy
    parts = {name: f"{state}.{name}" for name in ("cells", "tally", "last", "subs")}
    if strategy.startswith("mw-"):
        subs = _sub_memories_udf(memory)(F.expr(parts["subs"]), F.expr(cell))
        same = [F.expr(parts[name]).alias(name) for name in ("cells", "tally", "last")]
        return F.struct(*same, F.expr(f"{state}.seen + 1").alias("seen"), subs.alias("subs")).cast(STATE)
    if strategy in ("bruteforce", "ls-bruteforce"):
        parts["cells"] = f"concat({parts['cells']}, array({cell}))"
    elif strategy.startswith("ls-"):
        parts["tally"] = f"if(size({state}.last) > 0, {_counted(parts['tally'], f'{state}.last[0]', f'{state}.seen')}, {parts['tally']})"
        parts["last"] = f"array({cell})"
    else:
        parts["tally"] = _counted(parts["tally"], cell, f"{state}.seen")
    fields = ", ".join(f"'{name}', {parts.get(name, f'{state}.seen + 1')}" for name in ("cells", "tally", "last", "seen", "subs"))
    return F.expr(f"cast(named_struct({fields}) as {STATE})")


def elements(memory: MemoryConfig, state: str, dtype: ElementType = ElementType.String) -> Column:
    """array<array<string>> memory of a state (SQL): ``memory_column`` of the cells that it took."""
    strategy = memory.memory_strategy
    if strategy in ("bruteforce", "ls-bruteforce"):
        return F.expr(f"{state}.cells")
    if strategy.startswith("mw-"):
        return _sub_words_udf(memory)(F.expr(f"{state}.subs"))
    if strategy.endswith("mostfrequent"):
        # a tally is in the order in which its values were first seen
        found = F.expr(f"transform(filter({state}.tally, e -> e.n = array_max(transform({state}.tally, u -> u.n))), e -> e.value)")
    elif dtype is ElementType.String:
        found = _median_udf()(F.expr(f"{state}.tally"))
    else:
        found = F.expr(f"cast(array() as {CELLS})")
    return F.concat(found, F.expr(f"{state}.last")) if strategy.startswith("ls-") else found


def _entries(tally: list[dict]) -> list[Entry]:
    return [(tuple(t["value"]), t["n"], t["first"], t["last"]) for t in tally]


def _written(tally: Sequence[Entry]) -> list[dict]:
    return [{"value": list(v), "n": n, "first": a, "last": b} for v, n, a, b in tally]


def median_of(tally: Sequence[Entry]) -> str | None:
    """``median_word`` of the words that a tally of one-word cells counts."""
    if not tally:
        return None
    split = [(graphemes(v[0]), n, first, last) for v, n, first, last in tally]
    lengths: dict[int, list[int]] = {}
    for g, n, _, last in split:
        count = lengths.setdefault(len(g), [0, -1])
        count[0], count[1] = count[0] + n, max(count[1], last)
    length = min(lengths, key=lambda k: (-lengths[k][0], lengths[k][1]))
    target = list(min((x for x in split if len(x[0]) == length), key=lambda x: x[2])[0])
    counts: list[dict[str, list]] = [{} for _ in range(length)]
    for g, n, _, last in split:
        other = len(g) != length  # those come behind the words of that length
        row = align(g, target) if other else g
        for i in range(length):
            if row[i] is not None:
                seen = counts[i].setdefault(row[i], [0, (False, -1)])
                seen[0], seen[1] = seen[0] + n, max(seen[1], (other, last))
    return "".join(min(c, key=lambda k, c=c: (-c[k][0], c[k][1])) for c in counts)


def _stands_for(strategy: str, tally: Sequence[Entry]) -> str:
    """The word of a sub-memory."""
    if strategy == "mw-mostfrequent":
        most = max(n for _, n, _, _ in tally)
        return min((first, v[0]) for v, n, first, _ in tally if n == most)[1]
    return median_of(tally)


def add_words(memory: MemoryConfig, subs: list[list[Entry]], cell: Cell) -> list[list[Entry]]:
    """The sub-memories after one more cell; see ``multi_word``."""
    subs = [list(s) for s in subs]
    words = [_stands_for(memory.memory_strategy, s) for s in subs]
    for word in cell:
        best, at = 0.0, 0
        for i, value in enumerate(similarities(memory.multiword_distance_metric, [word] * len(words), words).tolist()):
            if value > best:
                best, at = value, i
        if subs and best >= memory.multiword_threshold_match:
            at = 0 if memory.compat_first_memory else at
        else:
            at = len(subs)
            subs.append([])
            words.append(word)
        subs[at] = add_entry(subs[at], (word,), sum(n for _, n, _, _ in subs[at]))
        words[at] = _stands_for(memory.memory_strategy, subs[at])
    return subs


def add_entry(tally: Sequence[Entry], value: Cell, place: int) -> list[Entry]:
    out = [(v, n + 1, first, place) if v == value else (v, n, first, last) for v, n, first, last in tally]
    return out if any(v == value for v, *_ in tally) else [*out, (value, 1, place, place)]


def _sub_memories_udf(memory: MemoryConfig):
    @F.arrow_udf(f"array<{TALLY}>")
    def more(subs: pa.Array, cells: pa.Array) -> pa.Array:
        return pa.array([
            # computed for rows without a cell too, whose state stays
            None if s is None or c is None or None in c else [_written(t) for t in add_words(memory, [_entries(t) for t in s], tuple(c))]
            for s, c in zip(subs.to_pylist(), cells.to_pylist(), strict=True)
        ], pa.list_(_TALLY_ARROW))

    return more


def _sub_words_udf(memory: MemoryConfig):
    @F.arrow_udf(CELLS)
    def found(subs: pa.Array) -> pa.Array:
        return pa.array([None if s is None else [[_stands_for(memory.memory_strategy, _entries(t)) for t in s]] if s else [] for s in subs.to_pylist()], pa.list_(pa.list_(pa.string())))

    return found


def _median_udf():
    @F.arrow_udf(CELLS)
    def found(tallies: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [[median_of(_entries(t))]] if t else [] for t in tallies.to_pylist()], pa.list_(pa.list_(pa.string())))

    return found


class Running:
    """The memory of cell after cell, in Python."""

    def __init__(self, memory: MemoryConfig):
        self.memory, self.strategy = memory, memory.memory_strategy
        self.base = self.strategy.removeprefix("ls-")
        self.cells: list[Cell] = []
        self.tally: dict[Cell, list[int]] = {}
        self.last: list[Cell] = []
        self.seen = 0
        self.subs: list[list[Entry]] = []

    def add(self, cell: Cell) -> None:
        if self.strategy.startswith("mw-"):
            self.subs = add_words(self.memory, self.subs, cell)
        elif self.base == "bruteforce":
            self.cells.append(cell)
        else:
            for value in self.last if self.strategy.startswith("ls-") else [cell]:
                count = self.tally.setdefault(value, [0, self.seen, 0])
                count[0], count[2] = count[0] + 1, self.seen
            self.last = [cell] if self.strategy.startswith("ls-") else []
        self.seen += 1

    def elements(self) -> list[Cell]:
        if self.strategy.startswith("mw-"):
            return [tuple(_stands_for(self.strategy, s) for s in self.subs)] if self.subs else []
        if self.base == "bruteforce":
            return list(self.cells)
        if self.base == "mostfrequent":
            most = max((n for n, _, _ in self.tally.values()), default=0)
            return [v for v, (n, _, _) in self.tally.items() if n == most] + self.last
        found = median_of([(v, *count) for v, count in self.tally.items()])
        return ([] if found is None else [(found,)]) + self.last


def running_memory(chains: DataFrame, memory: MemoryConfig, column: str = "value") -> DataFrame:
    """``chains`` (tracker_id, frame_idx, ...) with ``memory``: that of the non-null values before each row.

    A task reads its chains in order and holds the state of one, so a chain's
    cost is its length times its distinct values, and no chain is held whole.
    Columns of any names stay; rows of one frame are in no order. ``memory``
    replaces a column of that name.
    """
    names = [c for c in chains.columns if c != "memory"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            out = []
            for tracker, value in zip(batch["tracker_id"].to_pylist(), batch[column].to_pylist(), strict=True):
                if state is None or tracker != current:
                    state, current = Running(memory), tracker
                out.append(state.elements())
                if value is not None:
                    state.add((value,))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(out, pa.list_(pa.list_(pa.string())))], [*names, "memory"])

    ordered = chains.select(*names).repartition("tracker_id").sortWithinPartitions("tracker_id", "frame_idx")
    fields = [*(chains.schema[c] for c in names), T.StructField("memory", T.ArrayType(T.ArrayType(T.StringType())))]
    return ordered.mapInArrow(run, T.StructType(fields))


def running_latest(chains: DataFrame, column: str = "value") -> DataFrame:
    """``chains`` with ``latest``: the last non-null value before each row, the short-term half of the ls- memories."""
    before = Window.partitionBy("tracker_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    return chains.withColumn("latest", F.last(column, ignorenulls=True).over(before))
