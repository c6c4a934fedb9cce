"""Token ids in sorted-string-table shards.

A shard file holds documents in key order in blocks of about BLOCK_BYTES:

    block*  zstd of entries: shared u16 | key tail length u16 | ids u32 | ids u16/u32 ... | key tail
            (a key stands as what differs from the key before it in the block)
    index   zstd of msgless arrays: first key, offset, length of every block
    bloom   bits of every key
    footer  index offset, index length, bloom offset, bloom bits, documents, id bytes, magic

Keys are 9 bytes: 0 for a null doc_id or 1 and the big-endian doc_id with its
sign bit flipped, so byte order is numeric order. Lookup: Bloom filter, then
binary search in the sparse index, then one block.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import public_tokenizers
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinthread.llm.common import give_back, input_bytes, scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Input bytes of a shard, about.
SHARD_BYTES = 16 << 20
#: Distinct space-delimited pieces that a worker keeps with their ids.
CACHE = 600_000
MAGIC = b"KINSST01"
FOOTER = struct.Struct("<QQQQQB8s")
ENTRY = struct.Struct("<HHI")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def doc_id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_positions(key: bytes, bits: int) -> Iterator[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return ((a + i * b) % 2**64 % bits for i in range(BLOOM_HASHES))


class TableWriter:
    """Writes one shard; entries must come in key order. Memory: one block, the index, the keys."""

    def __init__(self, out, width: int = 2):
        self.out, self.at, self.width = out, 0, width
        self.block, self.size, self.last, self.first = [], 0, b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        data = ids.astype(f"<u{self.width}").tobytes()
        self.block += [ENTRY.pack(shared, len(key) - shared, len(ids)), data, key[shared:]]
        self.size += len(data) + 17
        self.last = key
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.compressor.compress(b"".join(self.block))
            self.index.append((self.first, self.at, len(data)))
            self.out.write(data)
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = self.compressor.compress(b"".join(struct.pack("<HQQ", len(k), at, n) + k for k, at, n in self.index))
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(-(-bits // 8), dtype=np.uint8)
        for key in self.keys:
            for p in _bloom_positions(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index)
        self.out.write(bloom.tobytes())
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.width, MAGIC))


class TableReader:
    """Reads a shard from a random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        at, n, bloom_at, self.bits, self.documents, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        raw = zstandard.ZstdDecompressor().decompress(self._read(at, n))
        self.bloom_at, self.index, p = bloom_at, [], 0
        while p < len(raw):
            k, block_at, length = struct.unpack_from("<HQQ", raw, p)
            self.index.append((raw[p + 18 : p + 18 + k], block_at, length))
            p += 18 + k

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = self.index[block]
        raw = zstandard.ZstdDecompressor().decompress(self._read(at, n))
        p, last = 0, b""
        while p < len(raw):
            shared, tail, count = ENTRY.unpack_from(raw, p)
            p += ENTRY.size
            ids = np.frombuffer(raw, dtype=f"<u{self.width}", count=count, offset=p)
            p += count * self.width
            last = last[:shared] + raw[p : p + tail]
            p += tail
            yield last, ids

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.index)):
            yield from self._entries(block)

    def may_hold(self, key: bytes) -> bool:
        return all(self._read(self.bloom_at + (p >> 3), 1)[0] >> (p & 7) & 1 for p in _bloom_positions(key, self.bits))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document under ``key``: repeated doc_ids may span blocks."""
        if not self.index or not self.may_hold(key):
            return []
        low, high = 0, len(self.index)
        while low < high:  # first block that begins at or after the key
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.index[middle][0] < key else (low, middle)
        found = []
        for block in range(max(0, low - 1), len(self.index)):
            if self.index[block][0] > key:
                break
            found += [ids for k, ids in self._entries(block) if k == key]
        return found


# --------------------------------------------------------------------- encoding


_SPACES = "\t\n\r\x0b\x0c"
_CUT = re.compile("[ \t\n\r\x0b\x0c]")
#: A full stop or comma between a Latin letter and white space is a pre-token of its own
#: (but not after the one letter whose lower case ends in a combining mark).
#: The stop stands first, so that a search skips to one.
_STOPS = re.compile(r"[.,](?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f].)(?=\s)")
#: What keeps a text from being lower-cased here: beyond Latin letters, whose
#: lower case is one composed letter whatever stands beside it.
_OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]")


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


# The settings of a tokenizer file for which pieces between white space can be encoded one by one.
PIECEWISE = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


@functools.lru_cache(maxsize=4)
def is_piecewise(path: str) -> bool:
    """Whether ``PieceEncoder`` gives the ids of the tokenizer file; of others whole texts are encoded."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    special = all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in found.get("added_tokens") or [])
    model = found["model"]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    return special and plain and all(found.get(k) == v for k, v in PIECEWISE.items())


@functools.lru_cache(maxsize=1)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder; its pieces stay known from task to task."""
    return PieceEncoder(path)


class WholeEncoder:
    """Encodes whole texts by the library: for any tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


class PieceEncoder:
    """Encodes texts piece by piece (runs without ASCII white space), each new piece once.

    The vocabulary's pre-tokens never span white space and its normaliser works
    on both sides of it alone, so the ids of a text are those of its pieces.
    A piece of Latin letters is one pre-token and goes to the merges directly;
    all others take the whole way.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = load_tokenizer(path), {"": b""}
        self.merges = self.tokenizer.model.tokenize
        self.letters = byte_letters()

    def _plain(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merges(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, many in one call; a token belongs to the piece that it begins in."""
        rest = []
        for piece in pieces:
            if piece.isalpha() and piece.islower() and not _OTHER.search(piece):
                self.known[piece] = self._plain(piece)
            else:
                rest.append(piece)
        for at in range(0, len(rest), 512):
            part = rest[at : at + 512]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4")
            begins = np.fromiter((a for a, _ in got.offsets), dtype=np.int64, count=len(ids))
            ends = np.cumsum([len(p) + 1 for p in part])
            cuts = np.searchsorted(begins, ends)
            data, low = ids.tobytes(), 0
            for piece, cut in zip(part, cuts.tolist(), strict=True):
                self.known[piece] = data[4 * low : 4 * cut]
                low = cut

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in segments(text):
            part = _STOPS.sub(r" \g<0>", part)
            for space in _SPACES:
                part = part.replace(space, " ")
            if "<|" not in part and not _OTHER.search(part):  # special tokens are told by case
                part = part.lower()
            pieces = part.split(" ")
            distinct = dict.fromkeys(pieces)
            if len(self.known) + len(distinct) > CACHE:
                self.known = {"": b""}
            new = [p for p in distinct if p not in self.known]
            if new:
                self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return np.frombuffer(b"".join(out), dtype="<u4")


def segments(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut at white space."""
    at = 0
    while len(text) - at > size:
        space = _CUT.search(text, at + size)
        if not space:
            break
        yield text[at : space.start()] + " "  # what stands before white space still does
        at = space.end()
    yield text[at:]


def write_tables(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, end_id: int | None = END_ID) -> str:
    """Encode every text and write the shards and a manifest under ``path``; returns the path.

    Rows are dealt to shards by ranges of doc_id and sorted there, null first;
    rows of one doc_id in text order. Null texts are empty; ``end_id`` ends each
    document. Only files named in the manifest count: what a lost or repeated
    task has left is not. Only doc_id and text are read. No rows: no shards.
    ``path`` is a folder that driver and executors share; ``vocabulary`` a
    tokenizer file that they all have. Its settings are looked at once: where
    pieces between white space can't be encoded one by one (``PIECEWISE``), whole
    texts are, by the library itself and slower. Very long texts are encoded
    1 Mi characters at a time in the first case, at once in the second.
    """
    spark, by_pieces = docs.sparkSession, is_piecewise(vocabulary)
    path = path or scratch_path(spark, "tokens")
    shards = max(1, input_bytes(docs) // SHARD_BYTES)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()  # what the worker's tasks before have left
        pieces = encoder(vocabulary) if by_pieces else WholeEncoder(vocabulary)
        width = 2 if pieces.tokenizer.get_vocab_size() <= 1 << 16 else 4
        files, folder = pafs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        rows, total, table, out = 0, 0, None, None
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if table is None:
                    out = files.open_output_stream(f"{folder}/{name}")
                    table = TableWriter(out, width)
                ids = pieces.encode(text if isinstance(text, str) else "")
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                table.add(key_of(None if doc_id is None else int(doc_id)), ids)
                rows, total = rows + 1, total + len(ids)
        if table is not None:
            table.close()
            out.close()
            del table, out, batch
            give_back()
            yield pd.DataFrame({"shard": [shard], "file": [name], "documents": [rows], "ids": [total]})

    manifest = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas has no whole numbers beside nulls
        .mapInPandas(write, "shard int, file string, documents long, ids long")
    )
    manifest.write.parquet(f"{path}/manifest")
    return path


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every document in the shards under ``path``.

    ``start`` counts the ids of all documents before: those of the shards
    before (a row a shard) and of the documents before in the shard.
    """
    return _read(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as read_tables, with a CRC-32 for the ids."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    manifest = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    name = column.split()[0]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, start in zip(batch["file"], batch["base"], strict=True):
                rows = []
                with files.open_input_file(f"{folder}/{file}") as source:
                    size = 0
                    for key, ids in TableReader(source):
                        rows.append((doc_id_of(key), start, len(ids), value(ids)))
                        start += len(ids)
                        size += len(ids)
                        if len(rows) >= 4096 or size >= 1 << 20:
                            yield _frame(rows, name)
                            rows, size = [], 0
                yield _frame(rows, name)

    # a given number of partitions isn't coalesced, however few bytes name the files
    files = max(1, manifest.count())
    return shards.select("file", "base", "shard").repartition(files, "shard").select("file", "base").mapInPandas(
        read, f"doc_id long, start long, n_tokens long, {column}"
    )


def _frame(rows: list[tuple], name: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", name])
    return out.assign(doc_id=out["doc_id"].astype("Int64"))


def lookup(path: str, file: str, doc_ids: Iterable[int | None]) -> dict[int | None, list[list[int]]]:
    """Ids of ``doc_ids`` in one shard file, by Bloom filter and binary search."""
    files, folder = pafs.FileSystem.from_uri(path)
    with files.open_input_file(f"{folder}/{file}") as source:
        table = TableReader(source)
        return {d: [ids.tolist() for ids in table.get(key_of(d))] for d in doc_ids}
