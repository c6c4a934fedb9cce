"""Words as grapheme clusters: splitting, edit scripts, modes and median words."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_CLUSTER = regex.compile(r"\X")


def graphemes(word: str) -> Sequence[str]:
    """Extended grapheme clusters; the string itself where each is one character."""
    if word.isascii() and "\r\n" not in word:
        return word
    return _CLUSTER.findall(word)


def grapheme_array(word: Column) -> Column:
    """array<string> of a string column's grapheme clusters, in the JVM."""
    return F.regexp_extract_all(word, F.lit(r"(\X)"), F.lit(1))


def join_graphemes(parts: Column) -> Column:
    return F.array_join(parts, "")


def first_mode(values: Iterable[Hashable]):
    """The value that reaches the highest count first; None for no values."""
    counts: dict = {}
    best, most = None, 0
    for v in values:
        counts[v] = counts.get(v, 0) + 1
        if counts[v] > most:
            best, most = v, counts[v]
    return best


def edit_script(source: Sequence[str], target: Sequence[str]) -> list[tuple[str, int]]:
    """("sub" | "del" | "add", position) edits that turn source into target, first to last.

    Unit costs. A substitution is taken only where strictly cheapest, a deletion
    only where cheaper than an addition. sub and add give positions in the
    target, del in the source.
    """
    n, m = len(source), len(target)
    cost = np.zeros((n + 1, m + 1), dtype=np.int64)
    cost[:, 0], cost[0, :] = np.arange(n + 1), np.arange(m + 1)
    table = cost.tolist()
    for i in range(1, n + 1):
        above, row = table[i - 1], table[i]
        for j in range(1, m + 1):
            row[j] = above[j - 1] if source[i - 1] == target[j - 1] else 1 + min(above[j - 1], above[j], row[j - 1])
    edits: list[tuple[str, int]] = []
    i, j = n, m
    while table[i][j]:
        if i and j and source[i - 1] == target[j - 1]:
            i, j = i - 1, j - 1
            continue
        sub = table[i - 1][j - 1] if i and j else None
        remove = table[i - 1][j] if i else None
        insert = table[i][j - 1] if j else None
        if sub is not None and sub < remove and sub < insert:
            edits.append(("sub", j - 1))
            i, j = i - 1, j - 1
        elif remove is not None and (insert is None or remove < insert):
            edits.append(("del", i - 1))
            i -= 1
        else:
            edits.append(("add", j - 1))
            j -= 1
    return edits[::-1]


def align(word: Sequence[str], target: Sequence[str]) -> list[str | None]:
    """``word`` stretched or cut to the target's length by the script's additions (None) and deletions."""
    out: list[str | None] = list(word)
    shift = 0
    for kind, at in edit_script(word, target):
        if kind == "add":
            out.insert(at, None)
            shift += 1
        elif kind == "del":
            del out[at + shift]
            shift -= 1
    return out


def median_word(words: Sequence[str]) -> str | None:
    """The word of the most frequent graphemes, position by position.

    Words of the most frequent length come first; the others are aligned to the
    first of them. Ties go to whatever reaches the count first. None for none.
    """
    if not words:
        return None
    split = [graphemes(w) for w in words]
    length = first_mode(map(len, split))
    same = [list(g) for g in split if len(g) == length]
    rows = same + [align(g, same[0]) for g in split if len(g) != length]
    return "".join(first_mode(r[i] for r in rows if r[i] is not None) for i in range(length))


def edit_script_udf():
    """Column function: the edit script from one string column to another, array<struct<kind, at>>."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32())]))

    @F.arrow_udf("array<struct<kind:string,at:int>>")
    def script(source: pa.Array, target: pa.Array) -> pa.Array:
        pairs = zip(source.to_pylist(), target.to_pylist(), strict=True)
        return pa.array([
            None if a is None or b is None else [{"kind": k, "at": i} for k, i in edit_script(graphemes(a), graphemes(b))]
            for a, b in pairs
        ], kind)

    return script


def median_word_udf():
    """Column function: the median word of an array of words; nulls in it don't count."""

    @F.arrow_udf("string")
    def median(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else median_word([x for x in w if x is not None]) for w in words.to_pylist()], pa.string())

    return median
