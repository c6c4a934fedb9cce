"""Phrase collocation mining: phrases of two and three words that occur more often than their parts explain.

1. A run of documents of one language (a *chunk*) keeps its words as numbers
   into the list of its distinct words, and breaks between pieces.
2. The lists are counted by word. Frequent words get dense ids; each chunk gets
   back the ids of its words, and breaks its pieces at all others.
3. A chunk's word pairs and triples become fixed-width keys (three ids of 32
   bits, the third 0 for a pair), sorted and counted; sorted keys are dealt to
   ranges of about RANGE_KEYS keys.
4. A range is radix-sorted and its runs are counted; what occurs often enough
   meets the counts of its parts in joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinthread.llm.common import SALTS, give_back, stored
from kinthread.llm.wordbytes import SLICE, byte_table, slices, utf8

LEAST = 10
TOP = 2000
#: A phrase inside a longer one goes if the longer one has this share, in per cent, of its occurrences.
SHARE = 50
#: Words of a chunk, about; with one slice more its distinct words must stay below 2**21.
CHUNK_WORDS = 1 << 20
#: Keys of a range, about; keys of one packed row; one key in so many is looked at for the bounds of ranges, and no more than MOST_SAMPLES in all.
RANGE_KEYS, ROW_KEYS, SAMPLE, MOST_SAMPLES = 1 << 20, 1 << 19, 512, 200_000
_FOLD = byte_table([0x09], b".,;:!?\n\x0b\x0c\r")
_BREAK = b"\n"
_CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("lang", pa.string()), ("carried", pa.int32()), ("tokens", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
])
_GRAMS = pa.schema([("n", pa.int64()), ("keys", pa.binary()), ("sample", pa.list_(pa.binary()))])
_RANGES = pa.schema([("range", pa.int32()), ("keys", pa.binary())])
_FOUND = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("a", pa.int64())])


class _Numbering(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of uint32, one length, as compressed byte planes."""
    planes = [c.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)[:, i].tobytes() for c in columns for i in range(4)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpack(data: bytes, columns: int = 1) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").reshape(-1) for p in planes]


def _pack_keys(x: np.ndarray, y: np.ndarray, z: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and their counts; the first id as differences."""
    return _pack(np.diff(x, prepend=np.uint32(0)), y, z, (n & 0xFFFFFFFF).astype(np.uint32), (n >> 32).astype(np.uint32))


def _unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, y, z, low, high = _unpack(data, 5)
    return np.cumsum(x, dtype=np.uint32), y, z, low.astype(np.int64) | high.astype(np.int64) << 32


class _Chunk:
    """The words of a language's documents, as far as a task has read."""

    def __init__(self, carried: list[bytes] = ()):
        self.numbers = _Numbering({_BREAK: 0})
        self.carried = len(carried)
        self.parts = [np.fromiter(map(self.numbers.__getitem__, carried), dtype=np.uint32, count=len(carried))]
        self.size = 0

    def add(self, part: bytes, last: bool) -> int:
        """Take the words of a part of a text; returns how many numbers they are."""
        found: list[int] = []
        number = self.numbers.__getitem__
        for i, piece in enumerate(part.split(_BREAK)):
            if i:
                found.append(0)
            found += map(number, piece.split())
        if last:
            found.append(0)
        self.parts.append(np.array(found, dtype=np.uint32))
        self.size += len(found)
        return len(found)

    def tail(self) -> list[bytes]:
        """The last two words, that the next chunk of a text begins with."""
        words = list(self.numbers)
        return [words[i] for i in np.concatenate(self.parts)[-2:].tolist()]

    def row(self, chunk: int, lang: str) -> pa.RecordBatch:
        stream = np.concatenate(self.parts)
        counts = np.bincount(stream[self.carried :], minlength=len(self.numbers))
        counts[0] = np.iinfo(np.int64).max  # the break stays 0
        # frequent words get small numbers: the high byte planes are then mostly zero
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.numbers)
        listed = pa.array([words[i] for i in order[1:].tolist()], pa.binary()).cast(pa.string())
        one = np.array([0, len(listed)], dtype=np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array([chunk], pa.int64()), pa.array([lang]), pa.array([self.carried], pa.int32()), pa.array([_pack(rank[stream])], pa.binary()),
            pa.ListArray.from_arrays(one, listed), pa.ListArray.from_arrays(one, pa.array(counts[order[1:]], pa.int64())),
        ], schema=_CHUNKS)


def _chunker(most_words: int, part_bytes: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunk rows of (lang, text)."""
        first, made, size = TaskContext.get().partitionId() << 32, 0, 0
        held: dict[str, _Chunk] = {}

        def rows():
            nonlocal made
            for lang, chunk in held.items():
                if chunk.size:
                    yield chunk.row(first + made, lang)
                    made += 1
            held.clear()
            give_back()

        give_back()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), utf8(batch["text"]), strict=True):
                parts = slices(text.translate(_FOLD), part_bytes)
                part = next(parts)
                while part is not None:
                    following = next(parts, None)
                    if lang not in held:
                        held[lang] = _Chunk()
                    size += held[lang].add(part, last=following is None)
                    if size >= most_words:
                        tail = held[lang].tail()
                        yield from rows()
                        size = 0
                        if following is not None:  # the text goes on
                            held[lang] = _Chunk(tail)
                    part = following
        yield from rows()

    return chunks


def _grams_of(row_keys: int, sample: int):
    def chunk_grams(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        """The sorted keys and counts of one chunk's pairs and triples of frequent words."""
        out = []
        local, given = replies["local"].to_numpy().astype(np.int64), replies["id"].to_numpy()
        for row in chunks.to_pylist():
            ids = np.sort(given)
            rank = np.zeros(int(local.max(initial=0)) + 2, dtype=np.uint64)
            rank[local] = np.searchsorted(ids, given).astype(np.uint64) + 1  # in the order of ids
            stream = _unpack(row["tokens"])[0]
            a = np.zeros(len(stream), dtype=np.uint64)
            inside = stream < len(rank)
            a[inside] = rank[stream[inside]]
            ids = np.concatenate([[0], ids]).astype(np.uint32)
            both = (a[:-1] > 0) & (a[1:] > 0)
            ending = np.arange(1, len(a)) >= row["carried"]
            pairs = np.flatnonzero(both & ending)
            triples = np.flatnonzero(both[:-1] & both[1:] & ending[1:])
            at = np.uint64(21)
            packed = np.concatenate([a[pairs] << (at + at) | a[pairs + 1] << at, a[triples] << (at + at) | a[triples + 1] << at | a[triples + 2]])
            del both, ending, pairs, triples, stream, inside, a
            packed.sort()
            begins = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
            counts = np.diff(np.append(begins, len(packed)))
            packed = packed[begins]
            mask = np.uint64((1 << 21) - 1)
            phase = (row["chunk"] * 0x9E3779B1 >> 7) % sample
            for low in range(0, len(packed), row_keys):
                some = packed[low : low + row_keys]
                x, y, z = ids[some >> (at + at)], ids[some >> at & mask], ids[some & mask]
                seen = np.stack([x[phase::sample], y[phase::sample], z[phase::sample]], axis=1).astype(">u4").tobytes()
                out.append({
                    "n": len(some), "keys": _pack_keys(x, y, z, counts[low : low + row_keys]),
                    "sample": [seen[i : i + 12] for i in range(0, len(seen), 12)],
                })
        give_back()
        return pa.Table.from_pylist(out, _GRAMS)

    return chunk_grams


def _bounds(samples: list[bytes], ranges: int) -> np.ndarray:
    """Keys (rows of three ids) at which ranges begin, but for the first one."""
    samples = sorted(samples)
    cuts = sorted({samples[len(samples) * i // ranges] for i in range(1, ranges)}) if samples else []
    return np.frombuffer(b"".join(cuts), dtype=">u4").astype(np.uint32).reshape(-1, 3)


def _cuts(x: np.ndarray, y: np.ndarray, z: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Where each range begins among sorted keys."""
    pair = x.astype(np.uint64) << np.uint64(32) | y
    wanted = bounds[:, 0].astype(np.uint64) << np.uint64(32) | bounds[:, 1]
    low, high = np.searchsorted(pair, wanted, "left"), np.searchsorted(pair, wanted, "right")
    return [int(a + np.searchsorted(z[a:b], t)) for a, b, t in zip(low, high, bounds[:, 2], strict=True)]


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of uint32 ``columns``, the first one most significant: 16 bits a pass, from the last.

    Digits that all rows share take no pass. (numpy sorts 16-bit numbers by radix.)
    """
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (0, 16):
            digit = (column >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` in order, and the sums of their counts."""
    if not len(counts):
        return columns, counts
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    begins = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))
    return [c[begins] for c in columns], np.add.reduceat(counts[order], begins)


def _frequent(least: int):
    def frequent(table: pa.Table) -> pa.Table:
        """The keys of a range that occur ``least`` times; what came is summed up whenever RANGE_KEYS more have."""
        held = [np.zeros(0, np.uint32)] * 3
        counts, waiting, size = np.zeros(0, np.int64), [], 0

        def summed():
            columns = [np.concatenate([c, *(w[i] for w in waiting)]) for i, c in enumerate(held)]
            return run_lengths(columns, np.concatenate([counts, *(w[3] for w in waiting)]))

        for packed in table["keys"]:
            waiting.append(_unpack_keys(packed.as_py()))
            size += len(waiting[-1][3])
            if size >= RANGE_KEYS:
                held, counts = summed()
                waiting, size = [], 0
        held, counts = summed()
        often = counts >= least
        give_back()
        return pa.table([pa.array(c[often].astype(np.int64)) for c in (*held, counts)], schema=_FOUND)

    return frequent


def word_chunks(docs: DataFrame) -> DataFrame:
    """Chunks (chunk, lang, carried, tokens, words, counts) of ``docs``, stored."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(_chunker(CHUNK_WORDS, SLICE), "chunk long, lang string, carried int, tokens binary, words array<string>, counts array<long>"), "word-chunks")


def _with_dense_ids(words: DataFrame) -> DataFrame:
    """``words`` with ids from 1, without gaps, in the order of its partitions; stored."""
    placed = stored(words.withColumn("at", F.monotonically_increasing_id()), "words")
    part = F.shiftright("at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # one row a partition
    begins = np.cumsum([0, *(r["count"] for r in sizes)])
    if begins[-1] >= 1 << 32:
        raise ValueError("more frequent words than 32 bits can tell apart")
    offsets = words.sparkSession.createDataFrame([(int(r.part), int(b)) for r, b in zip(sizes, begins, strict=False)], "part long, begin long")
    dense = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return stored(dense.select(*words.columns, (F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("id")), "dictionary")


def phrases(chunks: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(words, grams): words (lang, word, f, id) that occur ``least`` times in their language, and the
    phrases of two and three of them (x, y, z, a) that do, z = 0 for two.
    """
    spark = chunks.sparkSession
    listed = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select(
        "chunk", "lang", (F.col("pos") + 1).alias("local"), F.col("col.words").alias("word"), F.col("col.counts").alias("n"),
    )
    words = _with_dense_ids(listed.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    replies = listed.select("chunk", "lang", "local", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of"), "local", "id")
    grams = stored(
        chunks.select("chunk", "carried", "tokens").groupBy("chunk").cogroup(replies.groupBy("of"))
        .applyInArrow(_grams_of(ROW_KEYS, SAMPLE), "n long, keys binary, sample array<binary>"), "grams",
    )
    total, samples = grams.agg(F.sum("n"), F.sum(F.size("sample"))).first()
    ranges, stride = -(-(total or 0) // RANGE_KEYS), max(1, -(-(samples or 0) // MOST_SAMPLES))
    seen = grams.select(F.posexplode("sample").alias("i", "key"), "n").where(F.pmod(F.xxhash64("key", "i", "n"), F.lit(stride)) == 0)
    held = spark.sparkContext.broadcast(_bounds([bytes(r.key) for r in seen.select("key").collect()], ranges))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch["keys"]:
                columns = _unpack_keys(packed.as_py())
                cuts = [0, *_cuts(*columns[:3], held.value), len(columns[0])]
                some = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _, _ in some], pa.int32()), pa.array([_pack_keys(*(c[a:b] for c in columns)) for _, a, b in some], pa.binary()),
                ], schema=_RANGES)

    dealt = grams.select("keys").mapInArrow(deal, "range int, keys binary")
    return words, stored(dealt.groupBy("range").applyInArrow(_frequent(least), "x long, y long, z long, a long"), "phrases")


def _score(a: str, left: str, right: str) -> Column:
    """floor(10**6 * a * a / (left * right)), exact up to counts of 10**16."""
    wide = {c: f"cast({c} as decimal(16,0))" for c in (a, left, right)}
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide[a]} * {wide[a]})) div ({wide[left]} * {wide[right]})")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words.

    Texts, A-Z lower-cased, are cut into pieces at ``.,;:!?`` and line ends, and
    those into words at spaces and tabs. A phrase that occurs a >= ``least``
    times scores floor(10**6 * a * a / (l * r)), l and r the counts of its parts
    at the cut that scores lowest, the earliest of such. A phrase inside a
    longer one that has ``share`` per cent of its occurrences goes. Ranks go by
    score, a, and phrase in UTF-8 order; n is the language's number of words.

    A null lang is ``und``; null and empty texts have no words; repeated rows
    count each; texts are whole however long (words and phrases over the end of
    a chunk count once); only lang and text are read, other columns, of any
    names, change nothing. No rows, or none frequent, give none.
    """
    chunks = word_chunks(docs)
    words, grams = phrases(chunks, least)
    n = chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))

    def word(name: str, with_lang: bool = False) -> DataFrame:
        return words.select(F.col("id").alias(name), F.col("word").alias(f"word_{name}"), F.col("f").alias(f"f_{name}"), *(["lang"] if with_lang else []))

    pairs, triples = grams.where("z = 0").select("x", "y", "a"), grams.where("z > 0")
    # both pairs inside a triple that occurs often do so too
    inside = pairs.select("x", "y", F.col("a").alias("f_pair"))
    triples = triples.join(inside.withColumnRenamed("f_pair", "f_xy"), ["x", "y"]).join(
        inside.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("f_pair").alias("f_yz")), ["y", "z"])
    triples = stored(triples.select("x", "y", "z", "a", "f_xy", "f_yz"), "triples")
    longest = (
        triples.select("x", "y", "a").unionAll(triples.select("y", "z", "a")).groupBy("x", "y").agg(F.max("a").alias("longest"))
    )
    pairs = pairs.join(longest, ["x", "y"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    two = pairs.join(word("x", True), "x").join(word("y"), "y").select(
        "lang", F.concat_ws(" ", "word_x", "word_y").alias("phrase"), "a", F.struct(_score("a", "f_x", "f_y").alias("score"), F.lit(1).alias("k"), F.col("f_x").alias("l"), F.col("f_y").alias("r")).alias("cut"))
    three = triples.join(word("x", True), "x").join(word("y"), "y").join(word("z"), "z").select(
        "lang", F.concat_ws(" ", "word_x", "word_y", "word_z").alias("phrase"), "a", F.least(
            F.struct(_score("a", "f_x", "f_yz").alias("score"), F.lit(1).alias("k"), F.col("f_x").alias("l"), F.col("f_yz").alias("r")),
            F.struct(_score("a", "f_xy", "f_z").alias("score"), F.lit(2).alias("k"), F.col("f_xy").alias("l"), F.col("f_z").alias("r")),
        ).alias("cut"))
    scored = two.unionByName(three).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each of SALTS parts, then of what is left: no task sorts a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = scored.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
