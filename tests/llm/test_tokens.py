import hashlib
import json
import random
import tracemalloc
import types
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from kinthread.llm import bpe, common, tokenfiles

SCHEMA = "doc_id long, text string, ids string, n_tokens string"


def odd_texts():
    rng = random.Random(4)
    alphabet = list("abcXYZ019.,!?'\"-_ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　éßñÉİıſḰς字🙂👩‍👩‍👧`<|>") + ["<|endoftext|>", "'s", "'LL", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    return [None, "", " ", "\n\n  \n", "x" * 3000, "word " * 20_000, "àb ́c", "Σας ΣΑΣ", *texts]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(odd_texts())]
    rows += [(3, "again\n\n  \n", "x", "y"), (3, "again\n\n  \n", "x", "y"), (None, "no id", "x", "y"), (-5, "minus", "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_byte_bpe_equals_the_library_and_round_trips(spark, docs, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50_000)
    got = bpe.decode(bpe.encode(docs)).collect()
    encoding = bpe.load_encoding(bpe.RANKS)
    expected = sorted((r.doc_id is None, r.doc_id or 0, encoding.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == expected
    direct = bpe.encode(docs, with_decoded=True).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in direct) == sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got)
    texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).digest()) for r in docs.collect()}
    assert {(r.doc_id, hashlib.sha256(bytes(r.decoded)).digest()) for r in got} == texts


def test_byte_bpe_of_texts_without_a_word(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, None)]
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == ["1", "2", "2", "None"] and all(r.ids == [] and r.decoded == b"" for r in got)


def test_chunks_take_few_bytes_a_pretoken(monkeypatch):
    monkeypatch.setattr(bpe, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    words = [f" w{i}" for i in range(500)]
    rng = random.Random(5)
    texts = ["".join(rng.choices(words, k=4000)) for _ in range(200)]
    bpe.pretokens(texts[0])  # its classes are made once
    given = pd.DataFrame({"doc_id": map(str, range(len(texts))), "text": texts})
    tracemalloc.start()
    try:
        rows = list(bpe._chunks(iter([given])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    found = [(w, p) for row in rows for w, p in zip(map(bpe._unpack_words, row["words"]), map(bpe._unpack, row["positions"]), strict=True)]
    assert [w[i].decode() for w, p in found for i in p.tolist()] == [m for text in texts for m in bpe.pretokens(text)]
    assert peak < 14 * sum(len(p) for _, p in found)


def test_byte_bpe_of_documents_past_a_slice(spark):
    texts = ["some words " * 90_000, None, "other words " * 70_000, "", "last " * (bpe.SLICE + 5), "end", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    encoding = bpe.load_encoding(bpe.RANKS)
    assert {r.doc_id: r.ids for r in bpe.encode(rows).collect()} == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_splitting_equals_the_library_over_all_of_unicode():
    rng = random.Random(11)
    encoding, words = bpe.load_encoding(bpe.RANKS), bpe.load_word_encoding(bpe.RANKS)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\U0003f220\uba90", "\U00032b30\ub379", "\U0003dd80\ube6d", *("".join(map(chr, rng.choices(every, k=rng.randint(1, 12)))) for _ in range(5000))]
    for text in texts:
        assert [i for p in bpe.pretokens(text) for i in words.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_byte_bpe_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).collect() == []


def expected_tables(docs):
    tokenizer = tokenfiles.load_tokenizer(tokenfiles.VOCABULARY)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    out, start = [], 0
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        out.append((r.doc_id, start, ids))
        start += len(ids)
    return out


def test_token_tables_equal_the_library(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", max(1, tokenfiles.input_bytes(docs) // 3))
    monkeypatch.setattr(tokenfiles, "BLOCK_BYTES", 512)
    path = tokenfiles.write_tables(docs)
    expected = expected_tables(docs)
    got = sorted(tokenfiles.read_tables(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.ids) for r in got] == expected
    sums = sorted(tokenfiles.read_checksums(spark, path).collect(), key=lambda r: r.start)
    assert [r.ids_crc32 for r in sums] == [zlib.crc32(np.array(ids, dtype="<u4").tobytes()) for *_, ids in expected]
    files = [r.file for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert len(files) > 1
    wanted = [0, 3, 5, 200, None, -5, 99_999]
    found = {}
    for file in files:
        for d, ids in tokenfiles.lookup(path, file, wanted).items():
            found.setdefault(d, []).extend(ids)
    assert found == {d: [ids for e, _, ids in expected if e == d] for d in wanted}


@pytest.mark.parametrize("change", ["normalizer", "pre_tokenizer", "added_tokens"])
def test_other_tokenizer_files_are_encoded_as_the_library_does(spark, tmp_path, change):
    with open(tokenfiles.VOCABULARY, encoding="utf-8") as file:
        other = json.load(file)
    if change == "normalizer":
        other["normalizer"] = {"type": "NFC"}
    elif change == "pre_tokenizer":
        other["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    else:
        other["added_tokens"].append({"id": 49_900, "content": "two words", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(other, file)
    assert tokenfiles.is_piecewise(tokenfiles.VOCABULARY) and not tokenfiles.is_piecewise(path)
    texts = ["These are TWO words, two words  of\nsome Text", "", None, "École 12'345 don't\t stop"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.ids for r in tokenfiles.read_tables(spark, tokenfiles.write_tables(docs, vocabulary=path)).collect()}
    library = Tokenizer.from_file(path)
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, tokenfiles.END_ID] for i, t in enumerate(texts)}
    # by pieces these ids would be others
    assert any(tokenfiles.PieceEncoder(tokenfiles.VOCABULARY).encode(t or "").tolist() != got[i][:-1] for i, t in enumerate(texts))


def test_token_writers_give_memory_back(spark, tmp_path, monkeypatch):
    mark = str(tmp_path / "given")

    def told():
        with open(mark, "a") as out:
            out.write("x")

    monkeypatch.setattr(tokenfiles, "give_back", told)
    tokenfiles.write_tables(spark.createDataFrame([(1, "a text", "x", "y")], SCHEMA))
    with open(mark) as found:
        assert len(found.read()) == 2  # before its rows and after


def test_freed_memory_goes_back():
    def held():
        with open("/proc/self/smaps_rollup") as lines:
            return sum(int(line.split()[1]) for line in lines if line.startswith("Pss_Anon:"))

    blocks = [bytes([1]) * 60_000 for _ in range(2000)]
    kept = blocks[::100]  # what is still in use keeps the C library from giving back the rest by itself
    del blocks
    before = held()
    common.give_back()
    assert len(kept) == 20 and before - held() > 60_000


def test_token_tables_empty(spark):
    path = tokenfiles.write_tables(spark.createDataFrame([], SCHEMA))
    assert tokenfiles.read_tables(spark, path).collect() == []


def test_table_file_prefix_compression_and_bloom(tmp_path):
    fs, path = pafs.LocalFileSystem(), str(tmp_path / "t.sst")
    keys = [tokenfiles.key_of(i * 7) for i in range(5000)]
    with fs.open_output_stream(path) as out:
        table = tokenfiles.TableWriter(out)
        for i, key in enumerate(keys):
            table.add(key, np.arange(i % 50, dtype=np.uint32))
        table.close()
    with fs.open_input_file(path) as source:
        reader = tokenfiles.TableReader(source)
        assert len(reader.index) > 3 and reader.documents == 5000
        assert [k for k, _ in reader] == keys
        assert reader.get(keys[4321])[0].tolist() == list(range(4321 % 50))
        assert reader.get(tokenfiles.key_of(3)) == []
        assert sum(reader.may_hold(tokenfiles.key_of(i * 7 + 1)) for i in range(2000)) < 60
    (tmp_path / "bad.sst").write_bytes(b"x" * 200)
    with fs.open_input_file(str(tmp_path / "bad.sst")) as source, pytest.raises(ValueError):
        tokenfiles.TableReader(source)


def test_key_order_is_numeric():
    ids = [None, -(2**63), -5, -1, 0, 1, 2**40, 2**63 - 1]
    keys = [tokenfiles.key_of(i) for i in ids]
    assert keys == sorted(keys) and [tokenfiles.doc_id_of(k) for k in keys] == ids


def test_cache_overflow_keeps_results(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHE", 50)
    encoder = tokenfiles.PieceEncoder(tokenfiles.VOCABULARY)
    for text in odd_texts():
        expected = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encoder.encode(text or "").tolist() == expected


def test_long_texts_are_cut_between_pieces():
    text = "some Words, and. " * 50 + "\n" + "more<|endoftext|>\tİ. " * 40
    cut = list(tokenfiles.segments(text, 37))
    assert len(cut) > 20
    encoder = tokenfiles.PieceEncoder(tokenfiles.VOCABULARY)
    ids = np.concatenate([encoder.encode(part) for part in cut])
    assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
