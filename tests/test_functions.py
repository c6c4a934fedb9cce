import itertools
import math
import random
import time

import numpy as np
import pytest

from kinthread.config import DistanceMetricConfig, MemoryConfig, NormalizationConfig
from kinthread.functions import clustering, memories, similarity, words
from kinthread.schema import ElementType

LV, OPTI = DistanceMetricConfig("lv"), DistanceMetricConfig()
SUBSTRING = DistanceMetricConfig("lv_substring", lv_substring_weight=0.6)
MULTIWORD = DistanceMetricConfig("lv_multiword", lv_multiword_separator=" ")

PAIRS = [
    ("hello", "hello", 0, 5), ("hello", "", 5, 0), ("hello", "hallo", 1, 3), ("hello", "helloworld", 5, 5),
    ("bernart", "jeanbernard", 5, 6), ("Hello", "hello", 1, 4), ("Bernard", "bBeernard", 2, 6),
]


def edits(metric, a, b):
    return similarity.edits(metric, [a], [b])[0]


@pytest.mark.parametrize("a,b,count,longest", PAIRS)
def test_edit_counts(a, b, count, longest):
    for metric in (LV, OPTI, MULTIWORD, DistanceMetricConfig("lv_edit", lv_edit_weights=(1, 1, 1))):
        assert edits(metric, a, b) == count
    assert edits(SUBSTRING, a, b) == pytest.approx(max(count - 0.6 * longest, 0))


def test_multiword_edits():
    assert edits(MULTIWORD, "inspecteur des impots", "insp des impots") == 1
    assert edits(MULTIWORD, "inspecteur impots", "insp des impots") == 5
    assert edits(MULTIWORD, "inspecteur des impots", "inspe ds impts") == 7


def test_triangle_is_asymmetric_and_never_below_levenshtein():
    assert edits(OPTI, "bca", "abc") == 3 and edits(OPTI, "abc", "bca") == 2 and edits(LV, "bca", "abc") == 2
    every = ["".join(x) for n in (0, 1, 2, 3, 4) for x in itertools.product("abc", repeat=n)]
    rng = random.Random(1)
    left, right = rng.choices(every, k=4000), rng.choices(every, k=4000)
    full, triangle = similarity.edits(LV, left, right), similarity.edits(OPTI, left, right)
    assert (triangle >= full).all()
    longer = np.array([abs(len(a) - len(b)) >= 2 for a, b in zip(left, right, strict=True)])
    assert (triangle[longer] == full[longer]).all()


def plain_levenshtein(a, b):
    table = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return table[-1][-1]


def test_batches_of_mixed_lengths_and_scripts():
    rng = random.Random(2)
    words_ = ["".join(rng.choices("abcdé", k=rng.choice([0, 1, 3, 9, 40, 300]))) for _ in range(120)]
    left, right = rng.choices(words_, k=150), rng.choices(words_, k=150)
    found = similarity.edits(LV, left, right)
    assert [plain_levenshtein(a, b) for a, b in zip(left, right, strict=True)] == found.tolist()
    names, a, b = similarity._numbered(left, right)
    counts = similarity._by_length(similarity.Lexicon(names), a, b, similarity._scripts, 3)
    for a, b, c in zip(left, right, counts.tolist(), strict=True):
        if len(a) < 50 and len(b) < 50:
            script = words.edit_script(a, b)
            assert [sum(k == kind for k, _ in script) for kind in ("sub", "del", "add")] == c
    assert (counts.sum(axis=1) == found).all()


def test_few_pairs_are_as_many(monkeypatch):
    rng = random.Random(5)
    pool = ["".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(60)]
    left, right = rng.choices(pool, k=300), rng.choices(pool, k=300)
    for metric in (LV, OPTI, SUBSTRING, MULTIWORD, DistanceMetricConfig("lv_edit", lv_edit_weights=(3, 2, 1))):
        many = similarity.edits(metric, left, right)
        few = [similarity.edits(metric, [a], [b])[0] for a, b in zip(left, right, strict=True)]
        assert many.tolist() == few


def test_similarity_is_by_bytes_over_graphemes():
    assert math.isnan(similarity.similarities(OPTI, [""], [""])[0])
    assert similarity.similarities(LV, ["école"], ["ecole"])[0] == pytest.approx(1 - 1 / 6)
    assert similarity.similarities(LV, ["éa"], ["a"])[0] == pytest.approx(1 - 1 / 4)  # one cluster of two characters
    half = similarity.similarities(DistanceMetricConfig("lv", use_sigmoid=True), ["ab"], ["ac"])[0]
    assert half == pytest.approx(0.5)
    assert similarity.similarities(DistanceMetricConfig("lv_edit", lv_edit_weights=(3, 1, 1)), ["a"], ["b"])[0] in (pytest.approx(-2), pytest.approx(-1))


def test_edit_script_and_median_word():
    assert words.edit_script("hello", "hallo") == [("sub", 1)]
    assert words.edit_script("", "ab") == [("add", 0), ("add", 1)]
    assert words.median_word([]) is None
    assert words.median_word(["magimelien", "mazimilien", "mazirelien", "mazimelien"]) == "mazimelien"
    assert words.median_word(["abc", "abc", "ab", "abcd"]) == "abc"
    assert words.first_mode([1, 2, 2, 1]) == 2 and words.first_mode([]) is None


def test_average_linkage():
    assert clustering.average_linkage(np.array([[0, 1, 2], [1, 0, 3], [2, 3, 0]]), 2.0) == [[0], [1, 2]]
    found = clustering.average_linkage(np.array([[0, 1, 0.2, 0.3], [1, 0, 0.1, 0.2], [0.2, 0.1, 0, 0.9], [0.3, 0.2, 0.9, 0]]), 0.6)
    assert sorted(found) == [[0, 1], [2, 3]]


RULES = NormalizationConfig(0.6, 2, True, OPTI)


def test_normalize_words():
    names = ["magimelien", "mazimilien", "mazirelien", "marinelien", "hgdfzs", "bob", "boob"]
    assert clustering.normalize_words(names, RULES) == ["mazimelien"] * 5 + ["bob"] * 2
    assert clustering.normalize_words(["a", None, "xyz"], RULES) == ["a", None, "xyz"]
    assert clustering.normalize_words([None, "bob", "bob", None], RULES) == ["bob"] * 4
    kept = NormalizationConfig(0.6, 2, False, OPTI)
    assert clustering.normalize_words([None, "bob", "bob", "zzz"], kept) == [None, "bob", "bob", "zzz"]


def test_normalize_multi_words():
    cells = [
        ["emma", "edouard"], ["gustave", "edouard"], ["emma", "doriard"], ["emma", "gabriel"], ["auden", "emma"],
        ["emma", "edinard"], ["emma", "edouard"], ["edouard"], ["edouard"],
    ]
    assert clustering.normalize_multi_words(cells, RULES) == [["emma", "edouard"]] * 7 + [["edouard"]] * 2
    assert clustering.normalize_multi_words([["one"], None], RULES) == [[], []]


def test_memories():
    h = [("a",), ("b",), ("b",), ("a",), ("c",)]
    remember = memories.remember
    assert remember(MemoryConfig("bruteforce"), h) == h
    assert remember(MemoryConfig("mostfrequent"), h) == [("a",), ("b",)]
    assert remember(MemoryConfig("ls-mostfrequent"), h) == [("a",), ("b",), ("c",)]
    assert remember(MemoryConfig("median"), h) == [("b",)]
    assert remember(MemoryConfig("ls-median"), h) == [("b",), ("c",)]
    assert remember(MemoryConfig("median"), []) == [] and remember(MemoryConfig("ls-median"), []) == []
    assert remember(MemoryConfig("median"), [("a", "b")], ElementType.MultiStrings) == []


def test_multi_word_memory_and_its_compatible_form():
    rules = MemoryConfig("mw-mostfrequent", 0.6, LV)
    h = [("emma", "edouard"), ("emma", "edouart"), ("edouard", "paul")]
    assert memories.remember(rules, h) == [("emma", "edouard", "paul")]
    compat = MemoryConfig("mw-mostfrequent", 0.6, LV, compat_first_memory=True)
    assert memories.remember(compat, [("emma", "edouard"), ("edouart",), ("edouart",)])[0][0] in ("emma", "edouart")
    assert memories.remember(rules, []) == []


def slow_linkage(matrix, threshold):
    """Every merge looks at the whole matrix."""
    sim = np.array(matrix, dtype=np.float32)
    np.fill_diagonal(sim, 0)
    parts = [[i] for i in range(len(sim))]
    while len(parts) > 1:
        pairs = [(-sim[i, j], i, j) for i in range(len(parts)) for j in range(len(parts)) if not np.isnan(sim[i, j])]
        best, i, j = min(pairs)
        if not -best > threshold:
            break
        i, j = min(i, j), max(i, j)
        a, b = np.float32(len(parts[i])), np.float32(len(parts[j]))
        row, column = (sim[i] * a + sim[j] * b) / (a + b), (sim[:, i] * a + sim[:, j] * b) / (a + b)
        sim[i], sim[:, i] = row, column
        sim[i, i] = 0
        parts[i] = sorted(parts[i] + parts[j])
        last = len(parts) - 1
        if j != last:
            sim[j], sim[:, j] = sim[last].copy(), sim[:, last].copy()
            sim[j, j] = 0
            parts[j] = parts[last]
        parts.pop()
        sim = sim[:last, :last]
    return parts


def test_linkage_equals_a_search_of_the_whole_matrix():
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, *rng.integers(2, 16, 250)]:
        matrix = rng.integers(0, rng.choice([4, 10, 1000]), (n, n)).astype(np.float32) / 1000 * rng.choice([1, 100])
        if rng.random() < 0.5:
            matrix = np.maximum(matrix, matrix.T)
        if rng.random() < 0.3:
            matrix[rng.random((n, n)) < 0.2] = np.nan
        threshold = float(rng.choice([0.0, 0.002, 0.3]))
        assert clustering.average_linkage(matrix, threshold) == slow_linkage(matrix, threshold)


def test_linkage_of_many_words_takes_seconds():
    rng = np.random.default_rng(6)
    points = rng.random((3000, 2), dtype=np.float32)
    matrix = 1 - np.abs(points[:, None] - points[None]).sum(axis=2)
    began = time.time()
    found = clustering.average_linkage(matrix, 0.9)
    assert sorted(i for part in found for i in part) == list(range(3000)) and len(found) < 1500 and time.time() - began < 60
