import random
import time
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from kinthread.llm import jaccard

SF = "/root/testdata/sf0.001"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute_kept(rows):
    """doc_ids that stand for their group: all pairs compared."""
    found, label = [brute_set(t) for _, t in rows], list(range(len(rows)))
    near = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if found[i] == found[j] or Fraction(len(found[i] & found[j]), len(found[i] | found[j])) >= Fraction(4, 5)
    ]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return sorted({min(rows[j][0] for j in range(len(rows)) if label[j] == x) for x in label})


def test_pipeline_drops_texts_of_similarity_four_fifths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == brute_kept(rows)
    assert not {177, 145} & set(got)  # copies of 1 and 6 with J 0.83, 11 and 7 bits of their fingerprints apart


@pytest.mark.parametrize(("frequent", "known"), [(jaccard.FREQUENT, jaccard.KNOWN), (1, jaccard.KNOWN), (jaccard.FREQUENT, 0)])
def test_every_pair_is_found_at_the_border_and_in_dense_groups(spark, monkeypatch, frequent, known):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "KNOWN", known)  # with 0 all prefixes travel
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one two"), (5, "ONE  two")]
    for base in range(12):
        text = rng.choices(words, k=rng.choice([6, 12, 40, 90, 300]))
        for i in range(14):
            own = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            cut = rng.randint(0, len(own) // 8)
            rows.append((100 * base + 10 + i, " ".join(own[cut:] if rng.random() < 0.5 else own)))
    # 8 of 10 shingles: exactly four fifths; 7 of 9 less
    rows += [(5001, " ".join(f"b{i}" for i in range(14))), (5002, " ".join(f"b{i}" for i in range(12)))]
    rows += [(6001, " ".join(f"c{i}" for i in range(13))), (6002, " ".join(f"c{i}" for i in range(11)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in jaccard.one_of_each(docs).collect())
    assert got == brute_kept(rows) and {5001, 6001, 6002} <= set(got) and 5002 not in got
    assert jaccard.one_of_each(docs.where("false")).collect() == []


def test_shingles_are_counted_once_and_in_order():
    assert len(jaccard.shingles("a b c d e f a b c d e f")) == 6
    assert len(np.intersect1d(jaccard.shingles("a b c d e"), jaccard.shingles("e d c b a"))) == 0
    assert len(jaccard.shingles(" ")) == 0 and len(jaccard.shingles("a b")) == 1


def test_a_set_is_looked_up_in_many_known_tokens_without_passing_over_them():
    rng = np.random.default_rng(7)
    known = np.unique(rng.integers(0, 2**64, size=jaccard.KNOWN, dtype=np.uint64))
    sets = [np.concatenate([rng.choice(known, 20), rng.integers(0, 2**64, size=70, dtype=np.uint64)]) for _ in range(300)]
    began = time.process_time()
    got = [jaccard.among(found, known) for found in sets]
    assert time.process_time() - began < 2  # np.isin, which sorts them each time, takes some 2 s a set
    assert all((x[:20]).all() and not x[20:].any() for x in got)
    assert jaccard.among(known[:3], known[:0]).tolist() == [False] * 3
    assert jaccard.among(np.array([2**64 - 1], dtype=np.uint64), known[:5]).tolist() == [False]


def test_known_tokens_come_to_the_driver_without_an_object_each(spark):
    tokens = spark.range(-150_000, 150_000).selectExpr("id * 7 AS token")
    arrow = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")  # as the sessions of a cluster may have it
    tracemalloc.start()
    try:
        got = jaccard.collected(tokens)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
    assert (got == np.sort((np.arange(-150_000, 150_000) * 7).view(np.uint64))).all()
    assert peak < 8 * 300_000 * 6  # bytes; rows of one token each take ten times that
    assert len(jaccard.collected(tokens.where("false"))) == 0


@pytest.mark.parametrize("buckets", [jaccard.FREQUENT, 20_000])
def test_shingles_of_every_text_are_counted(spark, monkeypatch, buckets):
    monkeypatch.setattr(jaccard, "FREQUENT", buckets)
    rng = random.Random(9)
    texts = [None, ""] + [" ".join(rng.choices("abcd", k=rng.randint(1, 60))) for _ in range(400)] + ["own words that no other has"]
    texts += ["in more than two hundred of the texts"] * 300
    texts += [f"text {i}" for i in range(2 * 20_000)]  # a sample of 20 000 was looked at before
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = np.zeros(buckets, dtype=np.int64)
    for text in texts:
        for shingle in jaccard.shingles(text).tolist():
            want[shingle % buckets] += 1
    got = jaccard.bucket_counts(docs)
    assert (got == want).all() and got.max() >= 300
    assert not jaccard.bucket_counts(docs.where("false")).any()


def near_copies(rng, kind, count):
    """Distinct texts of one base: with up to 8 words changed ("hub"), or with some of 20 words as in another text ("none")."""
    words = [f"v{i}" for i in range(3000)]
    base, other, out = rng.sample(words, 150), rng.sample(words, 150), {}
    while len(out) < count:
        own = list(base)
        if kind == "hub":
            for i in rng.sample(range(150), rng.randint(0, 8)):
                own[i] = rng.choice(words)
        else:
            for i in range(3, 143, 7):
                own[i] = other[i] if rng.random() < 0.2 else own[i]
        out[" ".join(own)] = None
    return list(out)


@pytest.mark.parametrize("kind", ["hub", "none"])
def test_a_group_of_near_copies_is_not_compared_by_all_its_pairs(spark, monkeypatch, kind):
    rows = list(enumerate(near_copies(random.Random(5), kind, 800)))
    compared, verified = [], jaccard.verified

    def counted(pairs, *rest):
        compared.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in jaccard.one_of_each(docs).collect())
    assert got == brute_kept(rows)
    assert sum(compared) < 4 * len(rows), compared


def test_parities_differ_in_no_more_bits_than_sets_do():
    rng = np.random.default_rng(11)
    for _ in range(300):
        every = np.unique(rng.integers(0, 2**64, size=int(rng.integers(1, 900)), dtype=np.uint64))
        a, b = (every[rng.random(len(every)) < 0.9] for _ in range(2))
        bits = int(np.bitwise_count(jaccard.parities_of(a) ^ jaccard.parities_of(b)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (bits == 0 or len(np.setxor1d(a, b)) > 0)
        if jaccard.alike(a, b):
            assert bits * (jaccard.OVER + jaccard.UNDER) <= (len(a) + len(b)) * (jaccard.UNDER - jaccard.OVER)
    assert len(jaccard.parities_of(every)) == jaccard.PARITIES and not jaccard.parities_of(every[:0]).any()


def test_nearest_pairs_span_the_parts_that_may_be_alike():
    made = [jaccard.shingles(t) for t in near_copies(random.Random(6), "none", 60)]
    made += [jaccard.shingles(t) for t in near_copies(random.Random(7), "hub", 20)]
    n, fp = np.array([len(x) for x in made]), np.array([jaccard.fingerprint_of(x) for x in made], dtype=np.uint64)
    parities = np.array([jaccard.parities_of(x) for x in made])
    part = np.arange(len(made)) // 3  # threes are one part already
    found = jaccard.nearest(part, n, fp, parities)
    assert 0 < len(found) < len(set(part.tolist()))
    label = part.copy()
    for i, j in found:
        assert label[i] != label[j]
        label[label == label[i]] = label[j]
    assert all(label[i] == label[j] for i in range(len(made)) for j in range(i) if jaccard.alike(made[i], made[j]))
