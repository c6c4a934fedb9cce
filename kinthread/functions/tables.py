"""Edits between all words of two lists, many pairs an operation in numpy.

Plain Levenshtein is bit-parallel (Myers, in Hyyro's form): a left word is a
bit vector, and as many of them as fit share a machine word. The programme
below the diagonal runs cell by cell over tiles of bytes. Both are exact; lists
with longer words than they can take are left to ``similarity``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from kinthread.functions.words import graphemes

#: Graphemes that a bit vector takes, and that edits of a triangle in bytes stay below FAR with.
LONGEST, LONGEST_TRIANGLE = 64, 50
#: Right words of a tile of bit vectors; cells of a tile of bytes.
TILE, CELLS = 8192, 1 << 15
#: Words of a tile of trees.
PREFIX_TILE = 1 << 15
#: Cells over the diagonal.
FAR = 200
#: Kinds of graphemes that bounds tell apart, and how many of a kind they count one by one.
KINDS, TIMES = 32, 4


class Texts:
    """Right words, prepared once: their graphemes as columns of numbers, longer words first.

    ``order`` says which word of the list stands where; results are in that order.
    """

    def __init__(self, words: Sequence[str], parts_of: Callable[[str], Sequence[str]] = graphemes):
        split = [parts_of(w) for w in words]
        lengths = np.array([len(g) for g in split], dtype=np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.words = [words[i] for i in self.order.tolist()]
        self.bytes = np.array([len(w.encode()) for w in self.words], dtype=np.int64)
        self.longest = int(self.lengths.max(initial=0))
        self.numbers: dict[str, int] = {}
        if self.longest <= LONGEST:
            rows = np.zeros((len(words), max(1, self.longest)), dtype=np.intp)
            for row, i in zip(rows, self.order.tolist(), strict=True):
                row[: len(split[i])] = [self.numbers.setdefault(g, len(self.numbers)) for g in split[i]]
            self.columns = np.ascontiguousarray(rows.T)
            #: narrow ones, for comparisons
            self.narrow = self.columns.astype(np.uint8 if len(self.numbers) < 255 else np.int32)
        self.parts: dict[str, list] = {}
        self.kinds: tuple[np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.lengths)

    def bounds(self, left: Sequence[str]) -> np.ndarray | None:
        """float32 similarities (left words, right words) that none of plain edits, nor of edits below the diagonal, is over; None if a word is too long.

        An edit mends one grapheme that the words don't share. Shared ones are
        counted by kind, which is a product of matrices of zeros and ones.
        """
        split = [graphemes(w) for w in left]
        if max(max(map(len, split), default=0), self.longest) > LONGEST:
            return None
        if self.kinds is None:
            known = _kinds(self.columns, self.lengths)[0]
            used = np.flatnonzero(known.any(axis=0))
            self.kinds = np.ascontiguousarray(known[:, used].T), used
        rows = np.zeros((max(1, max(map(len, split), default=0)), len(left)), dtype=np.intp)
        for i, word in enumerate(split):
            rows[: len(word), i] = [self.numbers.get(g, -1) for g in word]
        mine, more = _kinds(rows, np.array([len(w) for w in split], dtype=np.int64))
        out = mine[:, self.kinds[1]] @ self.kinds[0]
        factors: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for row, word, text, over in zip(out, split, left, more.tolist(), strict=True):
            key = (len(word), len(text.encode()))
            if key not in factors:
                size = np.maximum(key[1], self.bytes).astype(np.float32)
                some = np.maximum(size, 1)
                factors[key] = (1 / some, np.where(size > 0, 1 - np.maximum(key[0], self.lengths) / some, 1).astype(np.float32))
            row += np.float32(over)
            row *= factors[key][0]
            row += factors[key][1]
        return out

    def levenshtein_of(self, left: Sequence[Sequence[str]], a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """Edits of single pairs: left words ``a`` and right words ``b`` by number; None if a word is too long."""
        mine = np.array([len(w) for w in left], dtype=np.int64)
        if max(mine.max(initial=0), self.longest) > LONGEST:
            return None
        kind = np.uint32 if mine.max(initial=0) <= 32 else np.uint64
        width, one = max(1, len(self.numbers)), kind(1)
        bits = np.zeros((max(1, len(left)), width), dtype=kind)
        for row, word in zip(bits, left, strict=False):
            for i, g in enumerate(word):
                if g in self.numbers:
                    row[self.numbers[g]] |= kind(1 << i)
        bits, masks = bits.reshape(-1), np.array([(1 << n) - 1 for n in mine.tolist()], dtype=kind)
        lengths = self.lengths[b]
        order = np.argsort((LONGEST - lengths).astype(np.uint8), kind="stable")
        a, b, lengths = a[order], b[order], lengths[order]
        begins = a * width
        p, q = np.full(len(a), np.iinfo(kind).max, dtype=kind), np.zeros(len(a), dtype=kind)
        for t in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            eq = bits.take(begins[:n] + self.narrow[t].take(b[:n]))
            vp, vn = p[:n], q[:n]
            v, h = eq | vn, (((eq & vp) + vp) ^ vp) | eq
            x, y = ((~(h | vp) | vn) << one) | one, (vp & h) << one
            np.bitwise_or(~(v | x), y, out=vp)
            np.bitwise_and(x, v, out=vn)
        mask = masks[a]
        out = np.empty(len(a), dtype=np.int64)
        out[order] = lengths + np.bitwise_count(p & mask) - np.bitwise_count(q & mask)
        return out

    def triangle_of(self, left: Sequence[Sequence[str]], a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """``levenshtein_of`` by the programme below the diagonal, the longer word first."""
        mine = np.array([len(w) for w in left], dtype=np.int64)
        if max(mine.max(initial=0), self.longest) > LONGEST_TRIANGLE:
            return None
        unknown = 255 if self.narrow.dtype == np.uint8 else -1
        chars = np.full((max(1, int(mine.max(initial=0))), len(left)), unknown, dtype=self.narrow.dtype)
        for i, word in enumerate(left):
            chars[: len(word), i] = [self.numbers.get(g, unknown) for g in word]
        shape = (mine[a] * 64 + self.lengths[b]).astype(np.uint16)
        order = np.argsort(shape, kind="stable")
        shape, begins = np.unique(shape[order], return_index=True)
        out = np.empty(len(a), dtype=np.uint8)
        for size, begin, end in zip(shape.tolist(), begins.tolist(), [*begins[1:].tolist(), len(a)], strict=True):
            la, lb = divmod(size, 64)
            for at in range(begin, end, CELLS):
                some = order[at : min(end, at + CELLS)]
                out[some] = _triangle_tile(chars[:la, a[some]][:, None], self.narrow[:lb, b[some]][:, None], la, lb, False)[0][0]
        return out

    def by_parts(self, separator: str, pieces) -> list[tuple]:
        """(number of parts, places of its words, they, their distinct parts, which part stands where) by number of parts, kept."""
        if separator not in self.parts:
            split = [pieces(graphemes(w), separator) for w in self.words]
            counts = np.array([len(p) for p in split], dtype=np.int64)
            found = []
            for n in np.unique(counts).tolist():
                at = np.flatnonzero(counts == n)
                words = Texts([self.words[i] for i in at.tolist()])
                at = at[words.order]
                distinct: dict[str, int] = {}
                numbers = np.array([[distinct.setdefault("".join(p), len(distinct)) for p in split[i]] for i in at.tolist()], dtype=np.intp).reshape(len(at), n)
                parts = Texts(list(distinct))
                rank = np.empty(len(distinct), dtype=np.intp)
                rank[parts.order] = np.arange(len(distinct))
                found.append((n, at, words, parts, rank[numbers]))
            self.parts[separator] = found
        return self.parts[separator]

    def levenshtein(self, left: Sequence[Sequence[str]]) -> np.ndarray | None:
        """uint8 edits (left words, right words); None if a word is too long."""
        most = max(map(len, left), default=0)
        if max(most, self.longest) > LONGEST:
            return None
        kind = np.dtype(next(k for bits, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if most <= bits))
        group = 8 // kind.itemsize
        out = np.empty((len(left), len(self)), dtype=np.uint8)
        tile = min(TILE, max(1, len(self)))
        taken = np.empty(tile, dtype=np.uint64)
        vp, vn, xv, xh, hp, hn = (np.empty(tile * group, dtype=kind) for _ in range(6))
        full, one = kind.type(np.iinfo(kind).max), kind.type(1)
        for at in range(0, len(left), group):
            some = left[at : at + group]
            bits = np.zeros((max(1, len(self.numbers)), group), dtype=kind)
            for lane, word in enumerate(some):
                for i, g in enumerate(word):
                    n = self.numbers.get(g)
                    if n is not None:
                        bits[n, lane] |= kind.type(1 << i)
            packed = bits.view(np.uint64)[:, 0]
            mask = np.array([(1 << len(w)) - 1 for w in some] + [0] * (group - len(some)), dtype=kind)
            for a in range(0, len(self), tile):
                lengths = self.lengths[a : a + tile]
                vp[: len(lengths) * group], vn[: len(lengths) * group] = full, 0
                for t in range(int(lengths[0])):
                    n = int(np.searchsorted(-lengths, -t, side="left"))  # words of over t graphemes
                    m = n * group
                    np.take(packed, self.columns[t, a : a + n], out=taken[:n], mode="clip")
                    eq, p, q, v, h, x, y = taken[:n].view(kind), vp[:m], vn[:m], xv[:m], xh[:m], hp[:m], hn[:m]
                    np.bitwise_or(eq, q, out=v)
                    np.bitwise_and(eq, p, out=h)
                    np.add(h, p, out=h)
                    np.bitwise_xor(h, p, out=h)
                    np.bitwise_or(h, eq, out=h)
                    np.bitwise_or(h, p, out=x)
                    np.invert(x, out=x)
                    np.bitwise_or(x, q, out=x)
                    np.bitwise_and(p, h, out=y)
                    np.add(x, x, out=x)
                    np.bitwise_or(x, one, out=x)
                    np.add(y, y, out=y)
                    np.bitwise_or(v, x, out=p)
                    np.invert(p, out=p)
                    np.bitwise_or(p, y, out=p)
                    np.bitwise_and(x, v, out=q)
                p, q = (w[: len(lengths) * group].reshape(-1, group) & mask for w in (vp, vn))
                found = lengths[:, None].astype(np.uint8) + np.bitwise_count(p) - np.bitwise_count(q)
                out[at : at + len(some), a : a + tile] = found.T[: len(some)]
        return out

    def triangle(self, left: Sequence[Sequence[str]], runs: bool = False) -> tuple[np.ndarray, np.ndarray | None] | None:
        """uint8 (edits, longest common runs if asked for) of the programme below the diagonal, the longer word first; None if a word is too long."""
        mine = np.array([len(w) for w in left], dtype=np.int64)
        if max(mine.max(initial=0), self.longest) > LONGEST_TRIANGLE:
            return None
        out = np.empty((len(left), len(self)), dtype=np.uint8)
        longest = np.zeros(out.shape, dtype=np.uint8) if runs else None
        starts = np.flatnonzero(np.diff(self.lengths, prepend=-1)).tolist() if len(self) else []
        for la in np.unique(mine).tolist():
            rows = np.flatnonzero(mine == la)
            unknown = 255 if self.narrow.dtype == np.uint8 else -1
            chars = np.array([[self.numbers.get(g, unknown) for g in left[i]] for i in rows.tolist()], dtype=self.narrow.dtype).reshape(len(rows), la)
            for begin, end in zip(starts, [*starts[1:], len(self)], strict=True):
                lb = int(self.lengths[begin])
                width = min(end - begin, CELLS)
                step = max(1, CELLS // width)
                for a in range(begin, end, width):
                    columns = self.narrow[:lb, a : min(end, a + width)]
                    for r in range(0, len(rows), step):
                        found = _triangle_tile(chars[r : r + step].T[:, :, None], columns[:, None], la, lb, runs)
                        place = np.ix_(rows[r : r + step], range(a, a + columns.shape[1])) if len(rows) != len(left) else (slice(r, r + step), slice(a, a + columns.shape[1]))
                        out[place] = found[0]
                        if runs:
                            longest[place] = found[1]
        return out, longest


class Prefixes:
    """Right words as trees of common beginnings, or ends if they share more: edits up to one are computed once for all words that have it.

    ``order`` says which word of the list stands where; results are in that order.
    Words next to each other in the alphabet share a tile.
    """

    def __init__(self, words: Sequence[str]):
        split = [graphemes(w) for w in words]
        lengths = np.array([len(g) for g in split], dtype=np.int64)
        self.longest = int(lengths.max(initial=0))
        self.numbers: dict[str, int] = {}
        self.order, self.tiles, self.turned = np.arange(len(words)), [], False
        if self.longest <= LONGEST:
            rows = np.full((len(words), max(1, self.longest)), -1, dtype=np.int64)
            turned = rows.copy()
            for row, back, word in zip(rows, turned, split, strict=True):
                found = [self.numbers.setdefault(g, len(self.numbers)) for g in word]
                row[: len(found)], back[: len(found)] = found, found[::-1]
            ways = [_trees(letters, lengths) for letters in (rows, turned)]
            steps = [sum(len(letters) for tile in tiles for _, letters, _ in tile[2]) for _, tiles in ways]
            self.turned = steps[1] < steps[0]
            self.order, self.tiles = ways[self.turned]
        self.words = [words[i] for i in self.order.tolist()]
        self.bytes = np.array([len(w.encode()) for w in self.words], dtype=np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def levenshtein(self, left: Sequence[Sequence[str]]) -> np.ndarray | None:
        """uint8 edits (left words, right words); None if a word is too long."""
        mine = np.array([len(w) for w in left], dtype=np.int64)
        if max(int(mine.max(initial=0)), self.longest) > LONGEST:
            return None
        out = np.empty((len(left), len(self)), dtype=np.uint8)
        buffers = np.empty((9, PREFIX_TILE), dtype=np.uint64)
        least = -1
        for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
            bits = np.iinfo(kind).bits
            rows = np.flatnonzero((mine > least) & (mine <= bits)).tolist()
            least = bits
            for at in range(0, len(rows), 64 // bits):
                some = rows[at : at + 64 // bits]
                self._edits([left[i][::-1] if self.turned else left[i] for i in some], np.dtype(kind), buffers, out, some)
        return out

    def _edits(self, left: Sequence[Sequence[str]], kind: np.dtype, buffers: np.ndarray, out: np.ndarray, rows: list[int]) -> None:
        """Rows of ``out`` for as many left words as share a machine word."""
        group = 8 // kind.itemsize
        bits = np.zeros((max(1, len(self.numbers)), group), dtype=kind)
        for lane, word in enumerate(left):
            for i, g in enumerate(word):
                n = self.numbers.get(g)
                if n is not None:
                    bits[n, lane] |= kind.type(1 << i)
        packed, one = bits.view(np.uint64)[:, 0], kind.type(1)
        mask = np.array([(1 << len(w)) - 1 for w in left] + [0] * (group - len(left)), dtype=kind).view(np.uint64)[0]
        for begin, blank, levels in self.tiles:
            # vertical bits up and down of the nodes of a level; two pairs of them take turns
            (up, down, up2, down2), (taken, xv, xh, hp, hn) = buffers[:4], buffers[4:]
            up[0], down[0] = np.iinfo(np.uint64).max, 0
            at = begin
            for t, (parents, letters, ends) in enumerate([(None, None, blank), *levels]):
                n = 1 if letters is None else len(letters)
                if parents is not None:
                    np.take(up, parents, out=up2[:n], mode="clip")
                    np.take(down, parents, out=down2[:n], mode="clip")
                    up, up2, down, down2 = up2, up, down2, down
                if letters is not None:
                    np.take(packed, letters, out=taken[:n], mode="clip")
                    eq, p, q, v, h, x, y = (b[:n].view(kind) for b in (taken, up, down, xv, xh, hp, hn))
                    np.bitwise_or(eq, q, out=v)
                    np.bitwise_and(eq, p, out=h)
                    np.add(h, p, out=h)
                    np.bitwise_xor(h, p, out=h)
                    np.bitwise_or(h, eq, out=h)
                    np.bitwise_or(h, p, out=x)
                    np.invert(x, out=x)
                    np.bitwise_or(x, q, out=x)
                    np.bitwise_and(p, h, out=y)
                    np.add(x, x, out=x)
                    np.bitwise_or(x, one, out=x)
                    np.add(y, y, out=y)
                    np.bitwise_or(v, x, out=p)
                    np.invert(p, out=p)
                    np.bitwise_or(p, y, out=p)
                    np.bitwise_and(x, v, out=q)
                if len(ends):
                    p, q = (np.bitwise_count((b.take(ends) & mask).view(kind)) for b in (up, down))
                    p -= q
                    p += np.uint8(t)
                    found = p.reshape(-1, group)
                    for lane, row in enumerate(rows):
                        out[row, at - len(ends) : at] = found[:, lane]
                    at -= len(ends)


def _trees(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """(order of the words, tiles) from rows of letters.

    A tile is where its words end, which node the empty word is, and a level a
    letter: parents (None: those before, in their order), letters, nodes of the
    words that end there. In a tile longer words come first.
    """
    alphabet = np.lexsort(letters.T[::-1]) if len(letters) else np.arange(0)
    order, tiles = [np.zeros(0, dtype=np.int64)], []
    for begin in range(0, len(alphabet), PREFIX_TILE):
        words = alphabet[begin : begin + PREFIX_TILE]
        words = words[np.argsort(-lengths[words], kind="stable")]
        node, levels, size = np.zeros(len(words), dtype=np.int64), [], lengths[words]
        for t in range(int(size.max(initial=0))):
            alive = int(np.searchsorted(-size, -t, side="left"))  # words of over t letters
            key = node[:alive] * (letters.max() + 1) + letters[words[:alive], t]
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            rank = np.empty(len(first), dtype=np.int64)
            rank[np.argsort(first, kind="stable")] = np.arange(len(first))
            first = np.sort(first)
            parents = node[first].astype(np.intp)
            node = rank[inverse]
            ends = node[size[:alive] == t + 1].astype(np.intp)
            levels.append((None if np.array_equal(parents, np.arange(len(parents))) else parents, letters[words[first], t].astype(np.intp), ends))
        tiles.append((begin + len(words), np.zeros(int(np.count_nonzero(size == 0)), dtype=np.intp), levels))
        order.append(words)
    return np.concatenate(order), tiles


def _kinds(columns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(float32 0 or 1: whether a word has a kind of graphemes so many times, graphemes beyond TIMES of a kind) from columns of numbers; those under 0 are none."""
    out, more = np.zeros((len(lengths), KINDS, TIMES), dtype=np.float32), np.zeros(len(lengths), dtype=np.int64)
    seen = np.zeros((len(lengths), KINDS), dtype=np.int64)
    for t in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero((lengths > t) & (columns[t] >= 0))
        kind = columns[t, rows] % KINDS
        times = seen[rows, kind]
        few = times < TIMES
        out[rows[few], kind[few], times[few]] = 1
        more[rows[~few]] += 1
        seen[rows, kind] += 1
    return out.reshape(len(lengths), -1), more


def _triangle_tile(chars: np.ndarray, columns: np.ndarray, la: int, lb: int, runs: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """One tile: left words of one length, right words of one length, letter after letter; they meet as arrays do (lefts and 1, 1 and rights, say)."""
    shape = np.broadcast_shapes(chars.shape[1:], columns.shape[1:])
    rows, width = max(la, lb), min(la, lb)
    row, new = (np.full((width + 1, *shape), FAR, dtype=np.uint8) for _ in range(2))
    row[0] = 0
    run, new_run = ((np.zeros((width + 1, *shape), dtype=np.uint8) for _ in range(2)) if runs else (None, None))
    longest = np.zeros(shape, dtype=np.uint8) if runs else None
    same, turn = np.empty(shape, dtype=bool), np.empty(shape, dtype=np.uint8)
    for i in range(1, rows + 1):
        new[0] = i
        for j in range(1, min(i, width) + 1):
            x, y = (i, j) if la >= lb else (j, i)
            np.equal(chars[x - 1], columns[y - 1], out=same)
            mask = np.negative(same.view(np.uint8), out=same.view(np.uint8))
            cell = new[j]
            np.minimum(row[j - 1], row[j], out=cell)
            np.minimum(cell, new[j - 1], out=cell)
            np.add(cell, 1, out=cell)
            np.bitwise_xor(cell, row[j - 1], out=turn)
            np.bitwise_and(turn, mask, out=turn)
            np.bitwise_xor(cell, turn, out=cell)
            if runs:
                np.add(run[j - 1], 1, out=new_run[j])
                np.bitwise_and(new_run[j], mask, out=new_run[j])
                np.maximum(longest, new_run[j], out=longest)
        row, new = new, row
        if runs:
            run, new_run = new_run, run
    return row[width], longest
