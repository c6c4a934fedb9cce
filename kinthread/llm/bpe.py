"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Documents are split into pre-tokens. A run of documents (a *chunk*) keeps its
   pre-tokens as positions: numbers into the chunk's list of distinct words.
2. The lists, not the occurrences, are dealt out by word. Where a word's entries
   meet it is encoded once, and each chunk gets its words' ids back.
3. Every chunk reassembles its documents' ids by position.
4. Decoding is a step of its own: ids meet the token-byte table.

What is shuffled are packed rows: the words of each chunk by group, their ids,
and the positions. A word that is in every text has one entry a chunk, and past
GROUP_WORDS entries a group is split by chunks, so no word makes a hot key and
nothing grows faster than the texts.
"""

from __future__ import annotations

import base64
import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinthread.llm.common import give_back, stored

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters of text in a chunk, about.
CHUNK_BYTES = 20 << 20
#: Groups that words are dealt to, and word entries (a word of a chunk) that meet in one, about.
GROUPS, GROUP_WORDS = 64, 250_000
#: Longer texts are split match by match instead of into one list.
LONG_TEXT = 1 << 20
#: Numbers of a chunk that are worked on at once.
SLICE = 1 << 18


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def load_encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def load_word_encoding(path: str) -> tiktoken.Encoding:
    """Takes a whole text for one match: its merges alone."""
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def token_table(path: str) -> pa.Array:
    """The token-byte table: bytes by id; null where there is no such token."""
    ranks = load_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, number in ranks.items():
        out[number] = token
    return pa.array(out, pa.binary())


@functools.lru_cache(maxsize=1)
def _splitters() -> tuple[regex.Pattern, regex.Pattern | None, regex.Pattern]:
    """(pattern, characters it doesn't fit, pattern for texts with those).

    The library has its own Unicode tables, older or newer than those of the
    ``regex`` module. It tells its letters, digits and white space itself: an
    encoding of single bytes whose pattern is the class gives back the members.
    Texts without a character on which the two disagree are split by the
    module's classes; the others by the library's, spelled out.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    classes, odd = {}, set()
    for name, own in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        members = set(bytes(found).decode())
        odd |= members ^ set(regex.findall(own, every))
        classes[name] = _ranges(members)
    plain = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    spelled = PATTERN
    for name, body in classes.items():
        spelled = _spell(spelled, name, body)
    spelled = spelled.replace(r"\S", f"[^{classes[r'\s']}]")
    return regex.compile(plain), regex.compile(f"[{_ranges(odd)}]") if odd else None, regex.compile(spelled)


def _spell(pattern: str, name: str, body: str) -> str:
    """``pattern`` with the class ``name`` as its members, inside brackets and outside."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        if pattern.startswith(name, at):
            out.append(body if inside else f"[{body}]")
            at += len(name)
            continue
        step = 2 if pattern[at] == "\\" else 1
        inside = {"[": True, "]": False}.get(pattern[at], inside) if step == 1 else inside
        out.append(pattern[at : at + step])
        at += step
    return "".join(out)


def _ranges(members: set[str]) -> str:
    """The body of a character class."""
    codes = np.array(sorted(map(ord, members)), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(codes) > 1) + 1
    return "".join(f"\\U{p[0]:08x}-\\U{p[-1]:08x}" for p in np.split(codes, cuts) if len(p))


class _Numbering(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def pretokens(text: str):
    """The matches of the pattern, in order."""
    pattern, odd, spelled = _splitters()
    if odd is not None and not text.isascii() and odd.search(text):
        pattern = spelled
    if len(text) <= LONG_TEXT:
        return pattern.findall(text)
    return (m.group() for m in pattern.finditer(text))


def _pack(values: np.ndarray) -> bytes:
    """uint32 numbers as compressed byte planes, one plane in memory at a time."""
    raw = values.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    out = zstandard.ZstdCompressor(level=9).compressobj(size=raw.size)
    return b"".join([*(out.compress(raw[:, i].tobytes()) for i in range(4)), out.flush()])


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def _slices(n: int) -> Iterator[slice]:
    """numpy makes whole copies of 8 bytes of the numbers it looks up or counts: of a slice at a time."""
    return (slice(a, a + SLICE) for a in range(0, n, SLICE))


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), dtype="<u4", count=len(words))
    raw = len(words).to_bytes(4, "little") + lengths.tobytes() + b"".join(words)
    return zstandard.ZstdCompressor(level=9).compress(raw)


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    lengths = np.frombuffer(raw, dtype="<u4", count=n, offset=4).astype(np.int64)
    ends = np.cumsum(lengths) + 4 + 4 * n
    return [raw[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (chunk, doc_ids, counts, n_words, words, groups, positions) from (doc_id, text)."""
    first = TaskContext.get().partitionId() << 32
    made = 0
    numbers, ids, counts, parts, size = _Numbering(), [], [], [], 0

    def row():
        stream = np.concatenate([*parts, np.zeros(0, dtype=np.uint32)])
        parts.clear()
        seen = np.zeros(len(numbers), dtype=np.int64)
        for some in _slices(len(stream)):
            seen += np.bincount(stream[some], minlength=len(numbers))
        # frequent words get small numbers: the high byte planes are then mostly zero
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(numbers), dtype=np.uint32)
        rank[order] = np.arange(len(numbers), dtype=np.uint32)
        listed = list(numbers)
        numbers.clear()
        words = [listed[i].encode("utf-8", "surrogatepass") for i in order.tolist()]
        del listed
        packed, groups = _pack_words(words), _pack(_group_of(words))
        del words
        for some in _slices(len(stream)):
            stream[some] = rank[stream[some]]
        return pd.DataFrame({
            "chunk": [first + made], "doc_ids": [ids], "counts": [counts], "n_words": [len(rank)],
            "words": [packed], "groups": [groups], "positions": [_pack(stream)],
        })

    give_back()  # what the worker's tasks before have left
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            text = text if isinstance(text, str) else ""
            found = np.fromiter(map(numbers.__getitem__, pretokens(text)), dtype=np.uint32)
            parts.append(found)
            counts.append(len(found))
            ids.append(doc_id)  # as text: pandas has no whole numbers beside nulls
            size += len(text)
            if size >= CHUNK_BYTES:
                yield row()
                made += 1
                numbers, ids, counts, parts, size = _Numbering(), [], [], [], 0
                give_back()
    if ids:
        yield row()
    del numbers, ids, counts, parts
    give_back()


def _group_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) % np.uint32(GROUPS)


def encode(docs: DataFrame, ranks: str = RANKS, with_decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``: its text's token ids, no special tokens.

    Equal to encoding each match of the pattern by the ranks, as the library
    does, its Unicode tables included. Null and empty texts have no ids;
    repeated rows and null doc_ids are kept as they are; only doc_id and text
    are read, columns of other names change nothing; texts are whole however
    long. No rows, no result. ``ranks`` is a path that every executor has.
    ``with_decoded`` adds the column of ``decode``.

    Chunks are stored once in the shared folder; a lost executor costs rereads.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.StringType())),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("n_words", T.LongType()),
        T.StructField("words", T.BinaryType()), T.StructField("groups", T.BinaryType()), T.StructField("positions", T.BinaryType()),
    ])
    chunks = stored(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_chunks, schema), "chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, -(-total // (GROUPS * GROUP_WORDS)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, packed, groups in zip(batch["chunk"], batch["words"], batch["groups"], strict=True):
                words, group = _unpack_words(packed), _unpack(groups)
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.diff(group[order])) + 1
                dealt = np.split(order, cuts) if len(words) else []
                yield pd.DataFrame({
                    "word_group": [int(group[part[0]]) for part in dealt], "chunk": [chunk] * len(dealt),
                    "words": [_pack_words([words[i] for i in part.tolist()]) for part in dealt],
                }).astype({"word_group": "int32", "chunk": "int64"})

    def encode_group(part: pd.DataFrame) -> pd.DataFrame:
        merge = load_word_encoding(ranks).encode_ordinary
        known: dict[bytes, int] = {}
        flat, ends = array("I"), array("q", [0])  # the ids of word i end at ends[i + 1]
        entries = []
        for packed in part["words"]:
            words = _unpack_words(packed)
            for word in words:
                if word not in known:  # each distinct word once
                    known[word] = len(known)
                    flat.extend(merge(word.decode("utf-8")))
                    ends.append(len(flat))
            entries.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words)))
        del known
        ids, upto, lengths, found = np.array(flat, dtype=np.uint32), np.array(ends, dtype=np.int64), [], []
        for which in entries:
            begins = upto[which]
            n = upto[which.astype(np.int64) + 1] - begins
            lengths.append(_pack(n.astype(np.uint32)))
            found.append(_pack(ids[_spans(begins, n)]))
        give_back()
        return pd.DataFrame({"word_group": part["word_group"], "chunk": part["chunk"], "lengths": lengths, "ids": found})

    encoded = (
        chunks.select("chunk", "words", "groups").mapInPandas(deal, "word_group int, chunk long, words binary")
        .groupBy("word_group", F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part"))
        .applyInPandas(encode_group, "word_group int, chunk long, lengths binary, ids binary")
    )
    nothing = pa.schema([("doc_id", pa.string()), ("ids", pa.list_(pa.int32()))]).empty_table()

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        """One chunk's documents; Arrow throughout, so that no id becomes an object."""
        replies = list(zip(*(right[c].to_pylist() for c in ("word_group", "lengths", "ids")), strict=True))
        tables = []
        for row in left.to_pylist():
            group = _unpack(row["groups"])
            lengths, begins, flat, base = np.zeros(len(group), np.int32), np.zeros(len(group), np.int32), [], 0
            for number, packed_lengths, packed_ids in replies:
                mine = np.flatnonzero(group == number)
                n = _unpack(packed_lengths).astype(np.int32)
                lengths[mine], begins[mine] = n, base + np.cumsum(n, dtype=np.int32) - n
                flat.append(_unpack(packed_ids))
                base += len(flat[-1])
            ids = np.concatenate([*flat, np.zeros(0, np.uint32)]).astype(np.int32)
            stream = _unpack(row["positions"])
            upto = np.cumsum([0, *row["counts"]])
            low = 0
            while low < len(row["doc_ids"]):  # documents of about SLICE pre-tokens, one at least
                high = min(max(low + 1, int(np.searchsorted(upto, upto[low] + SLICE))), len(row["doc_ids"]))
                some = stream[upto[low] : upto[high]]
                n = lengths[some]
                # where each document's ids end: the ids up to its last pre-token
                ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[upto[low : high + 1] - upto[low]]
                tables.append(pa.table({
                    "doc_id": pa.array(row["doc_ids"][low:high], pa.string()),
                    "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[_spans(begins[some], n)])),
                }))
                low = high
            del stream, ids, group, lengths, begins, flat
        give_back()
        return pa.concat_tables(tables) if tables else nothing

    rows = (
        chunks.select("chunk", "doc_ids", "counts", "groups", "positions").groupBy("chunk")
        .cogroup(encoded.groupBy("chunk")).applyInArrow(reassemble, "doc_id string, ids array<int>")
    )
    rows = rows.withColumn("doc_id", F.col("doc_id").cast(kind))
    return decode(rows, ranks) if with_decoded else rows


def _spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices begins[i] .. begins[i] + lengths[i] - 1, one span after the other; a chunk has far below 2**31."""
    ends = np.cumsum(lengths, dtype=np.int64)
    out = np.repeat((begins - (ends - lengths)).astype(np.int32), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``encoded`` with ``decoded`` binary: the bytes of its ``ids``, null for null ids.

    A join with the token-byte table: the vocabulary file bounds it (50,256
    rows), so every worker has it, and a batch's ids take their rows of it at
    once; laid end to end those are the texts. Other columns pass through, but
    for one named decoded. An id that is null or that no token has is an error.
    """
    schema = T.StructType([f for f in encoded.schema.fields if f.name != "decoded"]).add("decoded", T.BinaryType())
    columns = [f.name for f in schema.fields[:-1]]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(ranks)
        for batch in batches:
            ids = batch["ids"]
            ends = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy())])
            found = table.take(pa.compute.list_flatten(ids))
            if found.null_count:
                raise ValueError("no such token")
            found = found.cast(pa.large_binary())
            offsets = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
            size = int(offsets[-1] - offsets[0])
            data = found.buffers()[2].slice(int(offsets[0]), size) if size else pa.py_buffer(b"")
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray((offsets - offsets[0])[ends])), data])
            if ids.null_count:
                texts = pa.compute.if_else(ids.is_valid(), texts, pa.scalar(None, pa.large_binary()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), texts.cast(pa.binary())], [*columns, "decoded"])

    return encoded.select(*columns).mapInArrow(joined, schema)
