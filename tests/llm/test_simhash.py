import random

import numpy as np
import xxhash

from kinthread.llm import simhash
from kinthread.llm.common import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\r\x0b\x0c":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fp); smallest doc_id reachable, per row position."""
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[j] < label[i] and (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                    label[i], changed = label[j], True
    return [min(rows[j][0] for j in range(len(rows)) if label[j] == x) for x in label]


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)
    return sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect())


def test_matches_brute_force_with_ties_nulls_and_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two")]
    for i in range(10, 60):
        docs.append((i, " ".join(rng.choices(words, k=rng.choice([5, 50, 400])))))
    for i in range(60, 100):
        base = docs[7 + i % 12][1].split()
        base[rng.randrange(len(base))] = "changed"
        docs.append((i, " ".join(base)))
    expected_fp = [(d, brute_fingerprint(t)) for d, t in docs]
    expected = sorted((d, f, c) for (d, f), c in zip(expected_fp, brute_components(expected_fp), strict=True))
    assert run(spark, docs) == expected


def test_empty_table(spark):
    assert run(spark, []) == []


def test_very_long_text_is_read_whole():
    text = " ".join(str(i) for i in range(30_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert sum(simhash._runs(b"a b  c d e", 3), []) == [b"a", b"b", b"c", b"d", b"e"]
    longer = " ".join(str(i) for i in range(200_000))
    assert simhash.fingerprint(longer) == brute_fingerprint(longer)
    assert simhash.fingerprint(text + " tail tail tail") != simhash.fingerprint("tail tail tail")


def test_every_link_meets_at_an_anchor_for_any_code():
    rng = np.random.default_rng(1)
    for dimension, width in ((4, 0), (9, 0), (11, 0), (4, 5), (9, 16)):
        a = rng.integers(0, 2**64, size=300, dtype=np.uint64)
        b = a.copy()
        for _ in range(3):
            b ^= np.uint64(1) << rng.integers(0, 64, size=300, dtype=np.uint64)
        seen = {}
        for name, fps in (("a", a), ("b", b)):
            rows, anchor, home = simhash.anchors_of(fps, dimension, width=width)
            for r, x, h in zip(rows.tolist(), anchor.tolist(), home.tolist(), strict=True):
                seen.setdefault((name, r), {})[x] = h
        for i in range(300):
            left, right = seen["a", i], seen["b", i]
            assert sum(left.values()) == (4 if width else 1)
            assert any((left[x] or right[x]) for x in left.keys() & right.keys())


def test_visits_stay_bounded_at_any_size():
    fps = np.random.default_rng(2).integers(0, 2**64, size=400, dtype=np.uint64)
    visits = {}
    for exponent in range(3, 12):
        dimension, width = simhash.plan(10**exponent)
        rows, _, _ = simhash.anchors_of(fps, dimension, width=width)
        visits[exponent] = len(rows) / len(fps)
    print(visits)
    assert max(visits.values()) <= 50


def test_cut_anchors_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_HOMES", 0)
    monkeypatch.setattr(simhash, "HOMES", 1)
    monkeypatch.setattr(simhash, "CUT_BITS", 4)
    test_matches_brute_force_with_ties_nulls_and_copies(spark)
    assert simhash.plan(100)[1] > 0


def test_dense_group_spans_without_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 64)
    rng = random.Random(9)
    fps = {0}
    while len(fps) < 500:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(20)))
    far = [rng.getrandbits(62) for _ in range(200)]
    every = sorted(fps) + far
    nodes = spark.createDataFrame([(x,) for x in every], "fp long")
    found = connected_components(simhash.links(nodes, len(every))).collect()
    got = {r.node: r.component for r in found}
    assert len({got[x] for x in fps}) == 1
    expected = brute_components([(x, x) for x in every])
    assert [got.get(x, x) for x in every] == expected
    assert simhash.links(nodes, len(every)).count() < 60 * len(every)


def test_one_of_each_takes_columns_of_any_type(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'a b' AS text, map('k', 1) AS m, 2 AS turn UNION ALL SELECT 1L, 'a b', map('k', 1), 2 UNION ALL SELECT 3L, 'a  b', NULL, 4")
    assert [tuple(r) for r in simhash.one_of_each(docs).collect()] == [(1, "a b", {"k": 1}, 2)]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    edges = spark.createDataFrame(path, "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


def test_one_of_each_keeps_one_row_of_every_group(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [
        (7, text, "a", 1), (4, text + " x", "a", 1), (4, text + " x", "a", 1), (None, text, "a", 1),
        (4, "another text of quite different words here", "b", 2), (9, None, "c", 3), (8, "", "c", 3),
        (None, "no id at all in this one group of words", "d", 4), (2**60 + 1, "alone with a large id", "e", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, k_id int")
    got = sorted(map(tuple, simhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([
        (4, text + " x", "a", 1), (4, "another text of quite different words here", "b", 2), (8, "", "c", 3),
        (None, "no id at all in this one group of words", "d", 4), (2**60 + 1, "alone with a large id", "e", 5),
    ], key=str)
