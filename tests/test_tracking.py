import dataclasses
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import kinthread as K
from kinthread import queries as Q
from kinthread.functions import memories, scorers, similarity
from kinthread.operators import candidates, components
from kinthread.operators import evaluation as E
from kinthread.operators import frames as R
from kinthread.operators import graph as G
from kinthread.operators import resolution, scoring, word_pairs
from kinthread.plans import normalization, sweep, tracking
from kinthread.runtime import stored
from kinthread.serialization import deserialize, serialize
from kinthread.sources import tables
from kinthread.streaming.tracking import StreamTracker

SF = "/root/testdata/sf0.001"
FIELD, TYPE = K.FieldSchema, K.ElementType


def test_scorers(spark):
    rows = [(0.5, 0.6, 0.7), (0.5, None, 0.7), (None, 0.6, None), (None, None, None)]
    df = spark.createDataFrame(rows, "a float, b float, c float")
    columns = [F.col(c) for c in "abc"]

    def run(rule):
        return [r.s for r in df.select(scorers.score(rule, columns).alias("s")).collect()]

    weights = (1.0, 2.0, 3.0)
    assert run(K.RecordScorerConfig()) == pytest.approx([0.6, 0.4, 0.2, 0.0], abs=1e-6)
    assert run(K.RecordScorerConfig("weighted-average", weights, 0.5)) == pytest.approx([0.6333333, 0.65, 0.4, 0.0], abs=1e-6)
    assert run(K.RecordScorerConfig("weighted-quadratic", weights, 0.5)) == pytest.approx([0.4066666, 0.43, 0.24, 0.0], abs=1e-6)
    assert math.isnan(run(K.RecordScorerConfig("weighted-average", weights, 0.0))[3])


def test_nan_is_not_interesting(spark):
    df = spark.createDataFrame([(float("nan"),), (0.6,), (0.61,)], "s float")
    assert df.where(scorers.interesting(F.col("s"), 0.6)).count() == 1


CASES = {
    "ideal": ([(0, 0, 0.8), (0, 1, 0.6), (0, 2, 0.5), (1, 0, 0.6), (1, 1, 0.8), (1, 2, 0.5), (2, 0, 0.5), (2, 1, 0.6), (2, 2, 0.8)], {0: 0, 1: 1, 2: 2}),
    "none": ([], {}),
    "suboptimal": (
        [(t, r, s) for t, row in enumerate([(0.6, 0.5, 0.3), (0.8, 0.6, 0.5), (0.7, 0.6, 0.5), (0.6, 0.5, 0.4)]) for r, s in enumerate(row)],
        {1: 0, 2: 1, 3: 2},
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_best_match(spark, name):
    pairs, expected = CASES[name]
    scores = spark.createDataFrame(pairs, "tracker_id long, record_idx long, score float")
    for found in (resolution.best_match(scores), resolution.best_match(scores, driver_pairs=0)):
        assert {r.tracker_id: r.record_idx for r in found.collect()} == expected


def test_simple_allows_conflicts(spark):
    scores = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.9), (2, 1, 0.9)], "tracker_id long, record_idx long, score float")
    assert {(r.tracker_id, r.record_idx) for r in resolution.simple(scores).collect()} == {(1, 0), (2, 0)}


def test_native_forms_equal_the_udf(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), ("école", "ecole"), (None, "a"), ("", "x")], "a string, b string")
    found = df.select(similarity.native_levenshtein(F.col("a"), F.col("b")).alias("n"), similarity.similarity_udf(K.DistanceMetricConfig("lv"))("a", "b").alias("u")).collect()
    for r in found:
        assert (r.n is None and r.u is None) or (math.isnan(r.n) and math.isnan(r.u)) or r.n == pytest.approx(r.u, abs=1e-6)
    lists = spark.createDataFrame([(["a", "b"], ["a"]), ([], ["a"]), (["a"], []), (None, ["a"])], "a array<string>, b array<string>")
    got = [r.s for r in lists.select(similarity.multi_similarity(F.col("a"), F.col("b"), similarity.native_levenshtein).alias("s")).collect()]
    assert got == [0.5, None, 0.0, None]


def test_memory_columns_equal_the_functions(spark):
    histories = [[["a"], ["b"], ["b"]], [], [["a"]], [["b"], ["a"], ["c"], ["a"], ["b"]]]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(histories)], f"i int, h {memories.CELLS}").repartition(3)
    for name in ("bruteforce", "mostfrequent", "median", "ls-bruteforce", "ls-mostfrequent", "ls-median"):
        rule = K.MemoryConfig(name)
        got = {r.i: r.m for r in df.select("i", memories.memory_column(rule, F.col("h")).alias("m")).collect()}
        assert got == {i: [list(c) for c in memories.remember(rule, [tuple(c) for c in h])] for i, h in enumerate(histories)}


METRICS = {
    "lv": K.DistanceMetricConfig("lv"), "lv_opti": K.DistanceMetricConfig(), "sigmoid": K.DistanceMetricConfig("lv", use_sigmoid=True),
    "lv_edit": K.DistanceMetricConfig("lv_edit", lv_edit_weights=(0.8, 1.0, 1.5)),
}


@pytest.mark.parametrize("least", [0.3, 0.6, 0.8])
def test_blocking_loses_no_pair(spark, least):
    words = ["", "a", "ab", "abc", "abcd", "abcdefgh", "abXdefgh", "abXdefgY", "zzzzzzzz", "école", "ecole", "éàü", "漢字仮名交", "漢字仮名文", "漢", "éa", "0123456789012345", "01234567x9012345"]
    rng = random.Random(5)
    for _ in range(25):
        base = [rng.choice("abcé") for _ in range(rng.randint(1, 14))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
            words.append("".join(own))
    words = list(dict.fromkeys(words))
    df = spark.createDataFrame([(w,) for w in words], "v1 string")
    every = [(a, b) for a in words for b in words]
    found_at = {}
    for metric in METRICS.values():
        ratio = candidates.edit_ratio(metric, least)
        if ratio not in found_at:
            found_at[ratio] = {(r.v1, r.v2) for r in candidates.near_words(df, df.withColumnRenamed("v1", "v2"), ratio).collect()}
        found = found_at[ratio]
        values = similarity.similarities(metric, [a for a, _ in every], [b for _, b in every])
        assert {p for p, v in zip(every, values.tolist(), strict=True) if v > least} <= found
    assert candidates.edit_ratio(METRICS["lv"], 0.6) == pytest.approx(0.4)
    bounds = [candidates.bounded(m, least) for m in (*METRICS.values(), *LIST_METRICS.values())]
    assert all(bounds) or least < 0.5


LIST_METRICS = {
    "lv_substring": K.DistanceMetricConfig("lv_substring", lv_substring_weight=0.6),
    "no runs": K.DistanceMetricConfig("lv_substring", lv_substring_weight=0.0, use_sigmoid=True),
    "lv_multiword": K.DistanceMetricConfig("lv_multiword", lv_multiword_separator=" "),
}


@pytest.mark.parametrize("least", [0.4, 0.8])
def test_runs_and_parts_lose_no_pair(spark, least):
    """Words with long common runs, lists with equal parts in place, doubled separators, graphemes of several code points."""
    rng = random.Random(7)
    words = ["", " ", "a", "ab", "a b", "a  b", " a b", "a b ", "b a", "abcdefgh", "zzabcdefzz", "xabcdey", "école e\u0301t", "e\u0301t", "👩‍👩‍👧 x", "👩‍👩‍👧 xy", "漢字 仮名", "漢字 名"]
    names = ["jean", "jeanne", "anna", "ana", "marc", "du", "de", "e\u0301lie", "x"]
    for _ in range(60):
        words.append(rng.choice([" ", " ", "  "]).join(rng.choice(names) + rng.choice(["", "", "s"]) for _ in range(rng.randint(1, 4))))
        words.append("".join(rng.choices("abc", k=rng.randint(0, 5))) + "longrun" * rng.randint(0, 1) + "".join(rng.choices("abc ", k=rng.randint(0, 6))))
    words = list(dict.fromkeys(words))
    df = spark.createDataFrame([(w,) for w in words], "v1 string")
    every = [(a, b) for a in words for b in words]
    for name, metric in LIST_METRICS.items():
        if not candidates.bounded(metric, least):
            continue
        found = {(r.v1, r.v2) for r in candidates.similar_words(df, df.withColumnRenamed("v1", "v2"), metric, least).collect()}
        values = similarity.similarities(metric, [a for a, _ in every], [b for _, b in every])
        assert {p for p, v in zip(every, values.tolist(), strict=True) if v > least} <= found, name


SCORERS = {
    "average": K.RecordScorerConfig(),
    "weighted": K.RecordScorerConfig("weighted-average", weights=(3.0, 0.5, 2.0, 1.0), min_weight_ratio=0.4),
    "quadratic": K.RecordScorerConfig("weighted-quadratic", weights=(1.0, 1.0, 2.0, 0.0), min_weight_ratio=0.0),
}


def sparse_sides(spark, seed=11, n=60):
    """(trackers, records, schema): four features, one of few values, one a list; cells and memories are often absent."""
    rng = random.Random(seed)
    schema = K.RecordSchema([FIELD("name", TYPE.String), FIELD("place", TYPE.String), FIELD("code", TYPE.String), FIELD("kids", TYPE.MultiStrings)])
    people = [("".join(rng.choices("abehilno", k=8)), rng.choice(["north", "south"]), str(rng.randint(10**5, 10**6)), ["".join(rng.choices("xyz", k=5)) for _ in range(2)]) for _ in range(n)]

    def noisy(word):
        at = rng.randrange(len(word))
        return word[:at] + rng.choice(["", "a", "é"]) + word[at + 1 :] if rng.random() < 0.6 else word

    def absent(value):
        return None if rng.random() < 0.25 else value

    records = [(i, absent(noisy(a)), absent(b), absent(noisy(c)), absent([noisy(k) for k in d])) for i, (a, b, c, d) in enumerate(people)]
    memories_ = []
    for i, (a, b, c, d) in enumerate(people):
        cells = [absent([[noisy(a)], [noisy(a)]]), absent([[b]]), absent([[noisy(c)]]), absent([[noisy(k) for k in d]])]
        memories_.append((i, *(rng.choice([None, []]) if m is None else m for m in cells)))
    return (
        spark.createDataFrame(memories_, "tracker_id long, " + ", ".join(f"m{i} {memories.CELLS}" for i in range(4))),
        spark.createDataFrame(records, "record_idx long, name string, place string, code string, kids array<string>"), schema,
    )


@pytest.mark.parametrize("metric", ["lv", "lv_multiword"])
def test_word_pairs_give_the_same_scores_once(spark, metric):
    trackers, records, schema = sparse_sides(spark)
    rule = (METRICS | LIST_METRICS)[metric]
    table = word_pairs.WordPairs(spark, rule)

    def run(some, counts):
        found = scoring.score_pairs(trackers, some, schema, rule, SCORERS["average"], 0.6, words=table, counts=counts)
        return {(r.tracker_id, r.record_idx): (r.score, r.distances) for r in found.collect()}

    whole = scoring.score_pairs(trackers, records, schema, rule, SCORERS["average"], 0.6, all_pairs=10**9)
    want, counts = {(r.tracker_id, r.record_idx): (r.score, r.distances) for r in whole.collect()}, [{}, {}, {}]
    half = records.where("record_idx % 2 = 0")
    assert run(half, counts[0]) == {k: v for k, v in want.items() if k[1] % 2 == 0} and run(records, counts[1]) == want and len(want) >= 20
    # nothing is new the third time, and no pair was computed twice
    assert run(records, counts[2]) == want and counts[2]["new_words"] == 0 < counts[0]["new_words"]
    stored = table.table()
    assert stored.count() == stored.select("left_word", "right_word").distinct().count() == counts[0]["new_words"] + counts[1]["new_words"]
    assert counts[2]["possible"] == trackers.count() * records.count() > counts[2]["met"] >= len(want)


def test_joined_similarities_of_odd_cells(spark):
    """Null and empty memories, cells and words; NaN of two empty words; fields named like the columns used inside."""
    schema = K.RecordSchema([K.FieldSchema("w", K.ElementType.String), K.FieldSchema("part", K.ElementType.MultiStrings)])
    memories_ = [None, [], [[""]], [["ab"], [""]], [["abc"], ["abd"]]]
    lists = [None, [], [[]], [["ab", "cd"], []], [["", "x"]], [["a", "b", "ab"], ["b"]]]
    left = spark.createDataFrame([(i * 10 + j, m, n) for i, m in enumerate(memories_) for j, n in enumerate(lists)], f"tracker_id long, m0 {memories.CELLS}, m1 {memories.CELLS}")
    cells, others = [None, "", "ab", "é"], [None, [], [""], ["ab", "b", "b"]]
    right = spark.createDataFrame([(i * 10 + j, c, d) for i, c in enumerate(cells) for j, d in enumerate(others)], "record_idx long, w string, part array<string>")
    pairs = left.join(right, F.col("tracker_id") >= 0)
    want = scoring.pair_similarities(pairs, schema, K.DistanceMetricConfig("lv"))
    got, _ = word_pairs.joined_similarities(pairs, schema, word_pairs.WordPairs(spark, K.DistanceMetricConfig("lv")))
    a, b = ({(r.tracker_id, r.record_idx): str(r.distances) for r in d.collect()} for d in (want, got))
    assert a == b and len(a) == 480


@pytest.mark.parametrize(("name", "threshold", "metrics"), [("average", 0.6, ["lv", "lv_multiword"]), ("weighted", 0.7, ["lv"]), ("quadratic", 0.5, ["lv_edit"])])
def test_threshold_sums_lose_no_pair(spark, name, threshold, metrics):
    trackers, records, schema = sparse_sides(spark)
    for metric in ((METRICS | LIST_METRICS)[m] for m in metrics):
        want, got = (
            {(r.tracker_id, r.record_idx): (r.score, r.distances) for r in scoring.score_pairs(trackers, records, schema, metric, SCORERS[name], threshold, all_pairs=n).collect()}
            for n in (10**9, 0)
        )
        assert want == got and len(want) >= 20


def test_budget_goes_to_features_that_let_few_pairs_through(spark):
    trackers, records, schema = sparse_sides(spark, n=200)
    lacks = scoring.lacking(trackers, records, schema, METRICS["lv"], SCORERS["average"])
    shares = candidates.Budget(SCORERS["average"], 4, 0.6).shares(lacks, METRICS["lv"])
    assert shares[1] == 0 and sum(shares) == pytest.approx(0.4 * 4)
    assert candidates.Budget(SCORERS["average"], 4, 0.0).shares(lacks, METRICS["lv"]) is None


def test_candidates_of_the_frames_are_few(spark):
    """Under a twentieth of all pairs at the default threshold, before and after the whole budget is looked at."""
    records = Q.frames_table(spark, "/root/testdata/sf0.1").drop("members")
    trackers, frame = Q._first_memories(records, Q.STRINGS), Q._frame(records, 1)
    scorer, lv = K.RecordScorerConfig(), METRICS["lv"]
    every = trackers.count() * frame.count()
    lacks = scoring.lacking(trackers, frame, Q.STRINGS, lv, scorer)
    for threshold, most, kept in ((0.6, 0.05, 0.005), (0.7937, 0.01, 0.001)):
        budget = candidates.Budget(scorer, 3, threshold)
        shares = budget.shares(lacks, lv)
        met = candidates._reached(trackers, frame, Q.STRINGS, lv, [budget.least(s) if s else None for s in shares]).distinct().count()
        left = candidates.candidates(trackers, frame, Q.STRINGS, lv, scorer, threshold, lacks).count()
        print(f"threshold {threshold}: shares {shares}, met {met / every:.4f}, kept {left / every:.5f} of all pairs")
        assert met < 2 * most * every and left < kept * every


def test_many_records_meet_in_blocks(spark, monkeypatch):
    trackers, records, schema = sparse_sides(spark)
    want, got = None, None
    for most in (10**6, 13):
        monkeypatch.setattr(scoring, "BROADCAST_RECORDS", most)
        want, got = got, {(r.tracker_id, r.record_idx, r.score) for r in scoring.score_pairs(trackers, records, schema, METRICS["lv"], SCORERS["average"], -1.0).collect()}
    assert want == got and len(got) == trackers.count() * records.count()


def test_blocked_candidates_are_few(spark):
    """Before the edit distance is looked at: under a twentieth of all pairs at the default threshold."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(6, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "v1 string")
    for ratio, most in ((0.4, 0.05), (0.21, 0.002)):
        one, two = candidates.described(df, "v1", ratio), candidates.described(df.withColumnRenamed("v1", "v2"), "v2", ratio)
        shapes = one.select("b", "n", "k").distinct()
        met = candidates.segments(one, "v1").join(candidates.substrings(two, "v2", shapes, False), ["b", "n", "i", "segment"])
        met = met.union(candidates.segments(two, "v2").join(candidates.substrings(one, "v1", two.select("b", "n", "k").distinct(), True), ["b", "n", "i", "segment"]).select(*met.columns))
        assert met.count() < most * len(words) ** 2


def test_pair_similarities_equal_the_word_by_word_form(spark):
    memories_ = [[["abc"], ["abd", "x"]], [["a b"]], [], None, [["", "zz"]], [[]]]
    cells = [["abc", "abd"], ["a c", ""], [], None]
    words_ = ["abc", None, "", "école"]
    rows = [(i * 10 + j, j, m, m and [e[:1] or ["q"] for e in m], c, w) for i, m in enumerate(memories_) for j, (c, w) in enumerate(zip(cells, words_, strict=True))]
    df = spark.createDataFrame(rows, f"tracker_id long, record_idx long, m1 {memories.CELLS}, m0 {memories.CELLS}, kids array<string>, name string").repartition(3)
    schema = K.RecordSchema([FIELD("name", TYPE.String), FIELD("kids", TYPE.MultiStrings)])
    for metric in (K.DistanceMetricConfig(), METRICS["sigmoid"]):
        def like(a, b, metric=metric):
            return similarity.similarities(metric, [a], [b])[0]

        def best(values):
            numbers = [v for v in values if not np.isnan(v)]
            return max(numbers) if numbers else (values[0] if values else None)

        got = {r.tracker_id: r.distances for r in scoring.pair_similarities(df, schema, metric).collect()}
        for key, _, multi, single, kids, name in rows:
            expected = [best([like(e[0], name) for e in single]) if single and name is not None else None]
            sums = [np.float32(sum((best([like(w, k) for k in kids]) if kids else np.float32(0) for w in e), np.float32(0)) / np.float32(max(len(e), len(kids)))) for e in multi if e] if multi and kids is not None else []
            expected.append(best(sums))
            assert [None if x is None else (x if math.isnan(x) else pytest.approx(float(x))) for x in expected] == [x if x is None or not math.isnan(x) else expected[i] for i, x in enumerate(got[key])]


def test_ties_are_settled_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(resolution, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    n = 300
    scores = spark.range(n).selectExpr("id AS tracker_id").crossJoin(spark.range(n).selectExpr("id AS record_idx")).selectExpr("*", "CAST(1.0 AS FLOAT) AS score")
    found = {(r.tracker_id, r.record_idx) for r in resolution.mutual_best(scores).collect()}
    assert rounds.count("won") < 20
    assert found == {(t, r) for t, r, _ in resolution.greedy([(t, r, 1.0) for t in range(n) for r in range(n)])} and len(found) == n
    mixed = [(t, r, float(np.float32((t * r) % 5) / 5)) for t in range(25) for r in range(20)]
    got = resolution.mutual_best(spark.createDataFrame(mixed, "tracker_id long, record_idx long, score float")).collect()
    assert {(r.tracker_id, r.record_idx) for r in got} == {(t, r) for t, r, _ in resolution.greedy(mixed)}


def rising_path(n):
    """Pairs of a path, each better than the one before: settled one by one from its end."""
    return [((i + 1) // 2, i // 2, float(np.float32(0.5 + i / (2 * n)))) for i in range(n)]


def test_long_paths_and_stars_take_few_rounds(spark, monkeypatch):
    tables_ = []
    monkeypatch.setattr(resolution, "stored", lambda df, name: tables_.append(name) or stored(df, name))
    n = 100_000
    path = rising_path(n)
    star = [(10**6, 10**6 + i, float(np.float32((i * 7919) % n / n))) for i in range(n)]
    pairs = spark.createDataFrame(path + star, "tracker_id long, record_idx long, score float")
    got = {(r.tracker_id, r.record_idx) for r in resolution.mutual_best(pairs).collect()}
    assert got == {(t, r) for t, r, _ in resolution.greedy(path + star)}
    assert tables_.count("won") < 20


@pytest.mark.parametrize("together", [25])
def test_large_components_are_settled_from_their_better_half(spark, together):
    rng = random.Random(3)
    mixed = [(t, r, float(np.float32(rng.choice([0.5, 0.5, rng.random()])))) for t in range(12) for r in range(12) if rng.random() < 0.5]
    for given in (rising_path(90), mixed):
        got = resolution.mutual_best(spark.createDataFrame(given, "tracker_id long, record_idx long, score float"), together).collect()
        assert sorted((r.tracker_id, r.record_idx) for r in got) == sorted((t, r) for t, r, _ in resolution.greedy(given))
    assert resolution.mutual_best(spark.createDataFrame([], "tracker_id long, record_idx long, score float")).collect() == []


def test_components_of_pairs(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 10), (5, 5), (7, 1), (20, 21), (22, 21), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}


def test_config_checks_and_round_trip():
    schema = K.RecordSchema([FIELD("a", TYPE.String), FIELD("b", TYPE.MultiStrings)])
    made = K.config(schema, record_scorer_config=K.RecordScorerConfig("weighted-average", [1, 2], 0.7))
    assert made.tracker.interest_threshold == 0.6 and made.tracker.limit_no_match_streak == 10
    assert [m.memory_strategy for m in made.tracker.memories] == ["median", "mw-median"]
    assert deserialize(K.TrackingConfig, serialize(made)) == made
    rules = K.NormalizationConfig(0.6, 2)
    assert rules.infer_missing_clusters and deserialize(K.NormalizationConfig, serialize(rules)) == rules
    broken = serialize(made)
    del broken["tracker"]["memories"]
    for bad in (
        lambda: deserialize(K.TrackingConfig, broken), lambda: K.DistanceMetricConfig("other"), lambda: K.DistanceMetricConfig("lv_edit"),
        lambda: K.MemoryConfig("mw-median"), lambda: K.RecordScorerConfig("weighted-average"), lambda: K.ResolverConfig("x"),
        lambda: K.config(schema, record_scorer_config=K.RecordScorerConfig("weighted-average", [1], 0.7)),
    ):
        with pytest.raises(K.InvalidConfigError):
            bad()
    with pytest.raises(ValueError):
        K.RecordSchema([])


def test_frames_are_pruned_and_checked(spark):
    schema = K.RecordSchema([FIELD("a", TYPE.String), FIELD("b", TYPE.MultiStrings)])
    good = spark.createDataFrame([(2, "x", ["p"], 1), (1, None, None, 1)], "k int, a string, b array<string>, other int")
    records = R.records_of([good, good], schema, ["k"])
    assert records.columns == ["frame_idx", "record_idx", "a", "b"]
    assert [(r.frame_idx, r.record_idx, r.a) for r in records.orderBy("frame_idx", "record_idx").collect()] == [(0, 0, None), (0, 1, "x"), (1, 0, None), (1, 1, "x")]
    assert R.frame(records, schema, 0).where("a is null").first().b == []
    with pytest.raises(ValueError):
        R.prune(good.drop("a"), schema)
    with pytest.raises(ValueError):
        R.prune(good.withColumn("a", F.lit(1)), schema)
    with pytest.raises(ValueError):
        R.records_of([], schema, ["k"])
    bad = spark.createDataFrame([("x", ["p", None])], "a string, b array<string>")
    with pytest.raises(Exception, match="null inside a list"):
        R.prune(bad, schema).collect()


PEOPLE = K.RecordSchema([FIELD("name", TYPE.String), FIELD("street", TYPE.String), FIELD("children", TYPE.MultiStrings)])


@pytest.fixture(scope="module")
def register(spark):
    rows = [
        (0, 0, "bernard", "rue haute", ["emma", "paul"]), (0, 1, "dupont", "rue basse", []), (0, 2, "gone", "nowhere", None),
        (1, 0, "bernart", "rue haute", ["emma"]), (1, 1, "dupond", "rue basse", None), (1, 2, "newman", "quai", ["zoe"]),
        (2, 0, "bernard", "rue haut", ["ema", "paul"]), (2, 1, "neumann", "quai", ["zoe"]),
        (3, 0, "dupont", "rue basse", ["max"]), (3, 1, "bernard", None, ["emma", "paul"]),
    ]
    return spark.createDataFrame(rows, "frame_idx int, record_idx long, name string, street string, children array<string>")


@pytest.fixture(scope="module")
def graph(register):
    return tracking.track(K.config(PEOPLE, interest_threshold=0.5, limit_no_match_streak=1), PEOPLE, register)


def chains(graph):
    out = {}
    for r in graph.chain_nodes.orderBy("tracker_id", "frame_idx").collect():
        out.setdefault(r.tracker_id, []).append((r.frame_idx, r.record_idx))
    return out


def test_tracking_follows_people(graph):
    found = chains(graph)
    assert found[0] == [(0, 0), (1, 0), (2, 0), (3, 1)]
    assert found[1] == [(0, 1), (1, 1), (3, 0)]
    assert found[2] == [(0, 2)]
    assert found[(1 << 32) + 2] == [(1, 2), (2, 1)]
    assert [r.tracker_id for r in graph.trackers_ids.collect()] == sorted(found)
    # a tracker that missed more than the limit has no diagnostics any more
    assert {r.frame_idx for r in graph.diag_memory.where("tracker_id = 2").collect()} == {1, 2}
    total = {r.frame_idx: (sum(r.histogram_record_matchs), sum(r.histogram_tracker_matchs)) for r in graph.diag_resolving.collect()}
    assert total == {1: (3, 3), 2: (2, 4), 3: (2, 3)}


def test_tracking_does_not_depend_on_partitions(graph, register):
    again = tracking.track(K.config(PEOPLE, interest_threshold=0.5, limit_no_match_streak=1), PEOPLE, register.repartition(7))
    assert chains(again) == chains(graph)


def test_materialised_chain(graph, register):
    chain = graph.materialize_tracking_chain(1, register, PEOPLE)
    assert chain.length == 3 and chain.lifespan == 4
    assert [r.name for r in chain.as_dataframe().orderBy("frame_idx").collect()] == ["dupont", "dupond", "dupont"]
    assert chain.frames.where("record_idx is null").count() == 1
    with pytest.raises(ValueError):
        graph.materialize_tracking_chain(99, register, PEOPLE)
    with pytest.raises(ValueError):
        chain.as_dataframe(normalized=True)
    done = normalization.normalize(graph, register, PEOPLE, K.NormalizationConfig(0.6, 2))
    assert done.count() == register.count()
    normal = graph.materialize_tracking_chain(0, register, PEOPLE, done).as_dataframe(normalized=True)
    assert {r.name for r in normal.collect()} == {"bernard"} and {r.street for r in normal.collect()} == {"rue haute"}
    assert done.where("frame_idx = 0 and record_idx = 2").first().name == "gone"
    assert graph.tracker_diagnostics(0).count() == 3


def test_stored_graph(graph, tmp_path, spark):
    path = str(tmp_path / "graph")
    tables.save_graph(graph, path)
    assert chains(tables.read_graph(spark, path)) == chains(graph)
    with pytest.raises(K.InvalidStoreError):
        tables.read_graph(spark, str(tmp_path / "none"))
    holder = tables.GraphStore()
    holder.set_graph(graph)
    assert holder.take_diagnostics()[0] is graph.diag_records
    with pytest.raises(K.InvalidStoreError):
        holder.take_diagnostics()
    assert holder.take_graph().chain_nodes is graph.chain_nodes
    with pytest.raises(K.InvalidStoreError):
        holder.take_graph()


def test_a_broken_save_leaves_the_version_before(graph, tmp_path, spark, monkeypatch):
    path = str(tmp_path / "graph")
    tables.save_graph(graph, path)
    kept = tables.read_graph(spark, path)
    broken = dataclasses.replace(graph, nodes=graph.nodes.withColumn("record_idx", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        tables.save_graph(broken, path)
    assert chains(tables.read_graph(spark, path)) == chains(graph) and tables.read_graph(spark, path).nodes.count() == graph.nodes.count()
    # a graph read from a store may be saved there again
    fewer = dataclasses.replace(kept, chain_nodes=kept.chain_nodes.where("frame_idx = 0"))
    tables.save_graph(fewer, path)
    assert tables.read_graph(spark, path).chain_nodes.count() == graph.chain_nodes.where("frame_idx = 0").count()
    assert tables.prune_graph(spark, path) == 1 and tables.prune_graph(spark, path) == 0
    assert tables.read_graph(spark, path).diag_records.count() == graph.diag_records.count()
    assert not (tmp_path / "none").exists()


def test_csv_and_lists(spark, register, tmp_path):
    tables.write_yearly_csv(register, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == register.count() and back.where("frame_idx = 0 and record_idx = 0").first().children == "emma|paul"
    for year in (1835, 1837):
        (tmp_path / f"{year}.csv").write_text(f"name,kids\nx{year},a||b\ny,\n")
    read = tables.read_yearly_csv(spark, str(tmp_path), [1835, 1837]).orderBy("frame_idx", "line")
    assert [(r.frame_idx, r.line, r.name) for r in read.collect()] == [(0, 0, "x1835"), (0, 1, "y"), (1, 0, "x1837"), (1, 1, "y")]
    assert read.select(tables.split_list(F.col("kids")).alias("k")).first().k == ["a", "b"]
    # lines count on over the parts that a file is read in
    names = [f"{i * 7919 % 3001:04d}" for i in range(3000)]
    (tmp_path / "1840.csv").write_text("name\n" + "\n".join(names) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        parts = tables.read_yearly_csv(spark, str(tmp_path), [1840])
        assert parts.select("name").rdd.getNumPartitions() >= 1
        assert [(r.line, r.name) for r in parts.orderBy("line").collect()] == list(enumerate(names))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_years_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "1835.csv").write_text("name,street\nAnna,Rue A\n\"Eve, 2\",Rue Z\n")
    (tmp_path / "1836.csv").write_text("street,name\nRue B,Bert\n")
    (tmp_path / "1837.csv").write_text("name,\"odd `col\",street\nCarl,x,Rue C\n")
    (tmp_path / "1838.csv").write_text("name\nDora\n")
    (tmp_path / "1839.csv").write_text("name,name\nx,y\n")
    (tmp_path / "1841.csv").write_text("")
    years = [1835, 1836, 1837, 1838]
    table = tables.read_yearly_csv(spark, str(tmp_path), years)
    assert table.columns == ["name", "street", "odd `col", "frame_idx", "line"]
    assert [tuple(r) for r in table.orderBy("frame_idx", "line").collect()] == [
        ("Anna", "Rue A", None, 0, 0), ("Eve, 2", "Rue Z", None, 0, 1), ("Bert", "Rue B", None, 1, 0), ("Carl", "Rue C", "x", 2, 0), ("Dora", None, None, 3, 0),
    ]
    with pytest.raises(K.InvalidSchemaError, match="1838"):
        tables.read_yearly_csv(spark, str(tmp_path), [1835, 1838], missing="error")
    assert tables.read_yearly_csv(spark, str(tmp_path), [1836, 1835], missing="error").where("name = 'Bert'").first().frame_idx == 0
    for bad in (1839, 1841):
        with pytest.raises(K.InvalidSchemaError):
            tables.read_yearly_csv(spark, str(tmp_path), [1835, bad])


def test_stream_gives_the_batch_result(spark, register, graph, tmp_path):
    source = str(tmp_path / "in")
    register.where("frame_idx <= 1").coalesce(1).write.parquet(source)
    tracker = StreamTracker(K.config(PEOPLE, interest_threshold=0.5, limit_no_match_streak=1), PEOPLE)
    stream = spark.readStream.schema(register.schema).parquet(source)
    tracker.start(stream, str(tmp_path / "cp")).awaitTermination()
    register.where("frame_idx > 1").coalesce(1).write.mode("append").parquet(source)
    tracker.start(spark.readStream.schema(register.schema).parquet(source), str(tmp_path / "cp")).awaitTermination()
    assert chains(tracker.finish()) == chains(graph)


def test_stream_goes_on_after_a_lost_driver(spark, register, graph, tmp_path):
    rules, state = K.config(PEOPLE, interest_threshold=0.5, limit_no_match_streak=1), str(tmp_path / "state")
    frames = register.agg(F.max("frame_idx")).first()[0] + 1
    for k in range(frames):  # a tracker a batch
        tracker = StreamTracker(rules, PEOPLE, state)
        assert tracker.seen == k - 1
        tracker.on_batch(register.where(F.col("frame_idx") == k), k)
        tracker.on_batch(register.where(F.col("frame_idx") == k), k)  # delivered again
    assert chains(StreamTracker(rules, PEOPLE, state).finish()) == chains(graph)


def test_stream_keeps_late_rows_aside(spark, register, graph, tmp_path):
    """Frames in several batches, a record twice, rows of complete frames and of none: the batch run, and the late rows."""
    rules = K.config(PEOPLE, interest_threshold=0.5, limit_no_match_streak=1)
    top = register.agg(F.max("frame_idx")).first()[0]
    frame = {k: register.where(F.col("frame_idx") == k) for k in range(top + 1)}
    late = frame[0].withColumn("name", F.lit("too late")).limit(2)
    nowhere = frame[1].limit(1).withColumn("frame_idx", F.lit(None).cast("int"))
    even, odd = (frame[1].where(F.col("record_idx") % 2 == i) for i in (0, 1))
    batches = [frame[0], even, odd.union(frame[2].limit(1)).union(even.limit(1)), frame[2], *(frame[k] for k in range(3, top + 1)), late.union(nowhere)]
    for delay in (0, 1):
        # with no delay frame 1 is complete when frame 2 begins; its rows are there by then
        tracker = StreamTracker(rules, PEOPLE, str(tmp_path / f"late{delay}"), delay)
        for i, batch in enumerate(batches):
            tracker.on_batch(batch, i)
        assert chains(tracker.finish()) == chains(graph)
        assert sorted((r.frame_idx is None, r.frame_idx, r.batch) for r in tracker.late().collect()) == [(False, 0, len(batches) - 1)] * 2 + [(True, None, len(batches) - 1)]
        assert {r.frame_idx: r.n for r in tracker.late_counts().collect()} == {0: 2, None: 1}


def test_plans_do_not_grow_with_the_frames(spark, register):
    run, sizes = tracking.Tracking(K.config(PEOPLE, interest_threshold=0.5), PEOPLE), []
    for k in range(5):
        run.step(register.where(F.col("frame_idx") == k % 3))
        found = run.graph()
        sizes.append([len(str(getattr(found, n)._jdf.queryExecution().logical())) for n in ("chain_nodes", "nodes", "diag_records", "diag_resolving") if getattr(found, n) is not None])
    assert max(map(max, zip(*sizes[2:], strict=True))) <= 1.02 * max(sizes[2]) and all(abs(a - b) < 50 for a, b in zip(sizes[2], sizes[4], strict=True))


MEMORY_RULES = [
    K.MemoryConfig("bruteforce"), K.MemoryConfig("mostfrequent"), K.MemoryConfig("median"), K.MemoryConfig("ls-bruteforce"), K.MemoryConfig("ls-mostfrequent"), K.MemoryConfig("ls-median"),
    K.MemoryConfig("mw-median", 0.6, K.DistanceMetricConfig()), K.MemoryConfig("mw-mostfrequent", 0.5, K.DistanceMetricConfig(), True),
]


def odd_histories(seed=2, n=25):
    rng = random.Random(seed)
    return [["".join(rng.choices(["a", "b", "é", "c", "e\u0301"], k=rng.randint(0, 4))) for _ in range(rng.randint(0, 7))] for _ in range(n)]


@pytest.mark.parametrize("rule", MEMORY_RULES, ids=lambda r: r.memory_strategy)
def test_states_equal_whole_histories(spark, rule):
    """Cell after cell, in Catalyst, in Python and over sorted chains, as the functions of whole histories."""
    histories = odd_histories()
    for h in histories:
        run = memories.Running(rule)
        for w in h:
            run.add((w,))
        assert run.elements() == memories.remember(rule, [(w,) for w in h])
    df = spark.createDataFrame([(i, h) for i, h in enumerate(histories)], "id long, h array<string>")
    df = df.withColumn("state", memories.empty_state())
    for k in range(3):
        df = df.withColumn("state", F.when(F.size("h") > k, memories.with_cell(rule, "state", f"array(get(h, {k}))")).otherwise(F.col("state")))
    got = {r.id: [tuple(e) for e in r.m] for r in df.select("id", memories.elements(rule, "state").alias("m")).collect()}
    assert got == {i: memories.remember(rule, [(w,) for w in h[:3]]) for i, h in enumerate(histories)}
    rows = [(i, k, w if (i + k) % 5 else None, "m") for i, h in enumerate(histories) for k, w in enumerate(h)]
    chains_ = spark.createDataFrame(rows, "tracker_id long, frame_idx int, value string, memory string").repartition(3)
    want = {}
    for i, k, _, _ in rows:
        want[i, k] = memories.remember(rule, [(w,) for j, q, w, _ in rows if j == i and q < k and w is not None])
    found = memories.running_memory(chains_, rule)
    assert found.columns == ["tracker_id", "frame_idx", "value", "memory"]
    assert {(r.tracker_id, r.frame_idx): [tuple(e) for e in r.memory] for r in found.collect()} == want


def test_evaluation_of_nothing(spark):
    none = spark.createDataFrame([], "tracker_id long, frame_idx int, record_idx long")
    row = E.length_statistics(none).first()
    assert (row.average, row["median"], row.max, row.min, row.histogram) == (0.0, 0, 0, 0, [])
    one = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 0, 1)], "tracker_id long, frame_idx int, record_idx long")
    nodes = one.select("frame_idx", "record_idx").distinct()
    found = {r.frame_idx: r for r in E.graph_properties(one, nodes).collect()}
    assert found[1].conflict_ratio == 1.0 and found[0].records_match_ratio == 0.0 and math.isnan(found[1].trackers_match_ratio)
    assert G.edges(one).count() == 2


def test_sweep_and_summary(spark, register, tmp_path):
    configs = list(sweep.grid(PEOPLE, [K.DistanceMetricConfig("lv")], [K.RecordScorerConfig()], [K.MemoryConfig("bruteforce")], [K.MemoryConfig("bruteforce")], [0.5, 0.9]))
    assert len(configs) == 2
    assert sweep.run_sweep(configs, PEOPLE, register, "name", str(tmp_path / "s"), batch=1) == 2
    rows = tables.load_json(spark, str(tmp_path / "s")).collect()
    assert len(rows) == 2 and len({r.config for r in rows}) == 2
    for r in rows[:1]:
        one = configs[[f.tracker.interest_threshold for f in configs].index(json.loads(r.config)["tracker"]["interest_threshold"])]
        run = tracking.track(one, PEOPLE, register)
        lengths = [len(c) for c in chains(run).values()]
        assert (r.max, r.min) == (max(lengths), min(lengths)) and r.average == pytest.approx(sum(lengths) / len(lengths), abs=1e-5)
        assert r.histogram == [lengths.count(n) for n in range(max(lengths) + 1)]
    # a sweep goes on where it broke off
    assert sweep.run_sweep(configs, PEOPLE, register, "name", str(tmp_path / "s"), batch=1) == 0


def test_runs_side_by_side_are_those_alone(spark, register):
    """Metrics, memories (sub-memories too), thresholds, limits and strategies that differ; chains and diagnostics are those of each run alone."""
    lv, opti = K.DistanceMetricConfig("lv"), K.DistanceMetricConfig("lv_opti")
    mw = K.MemoryConfig("mw-median", 0.5, lv)
    rules = [
        K.config(PEOPLE, lv, None, K.ResolverConfig("simple"), K.MemoryConfig("median"), K.MemoryConfig("bruteforce"), 0.5, 1),
        K.config(PEOPLE, lv, None, K.ResolverConfig("best-match"), K.MemoryConfig("bruteforce"), mw, 0.4, 2),
        K.config(PEOPLE, opti, None, K.ResolverConfig("best-match"), K.MemoryConfig("ls-mostfrequent"), mw, 0.6, 1),
    ]
    runs = sweep.track_all(rules, PEOPLE, register)
    found = {}
    for r in runs.chains().collect():
        found.setdefault(r.config, set()).add((r.tracker_id, r.frame_idx, r.record_idx))
    for n, rule in enumerate(rules):
        alone, beside = tracking.track(rule, PEOPLE, register), runs.graph_of(n)
        assert found[n] == {tuple(r) for r in beside.chain_nodes.collect()} == {(r.tracker_id, r.frame_idx, r.record_idx) for r in alone.chain_nodes.collect()}
        for name in ("nodes", "diag_records", "diag_memory", "diag_resolving"):
            columns = sorted(getattr(alone, name).columns)
            a, b = (sorted(str(tuple(r)) for r in getattr(g, name).select(*columns).collect()) for g in (alone, beside))
            assert a == b, name
    with pytest.raises(ValueError):
        sweep.track_all([], PEOPLE, register)
    # another sweep finds the word pairs of the first one
    pairs = runs.tables[lv].table()
    assert pairs.count() == pairs.select("left_word", "right_word").distinct().count() > 0


def test_summaries_side_by_side_are_those_alone(spark, register):
    """All columns, of both strategies; one frame only has neither distances nor histograms."""
    lv = K.DistanceMetricConfig("lv")
    rules = [
        K.config(PEOPLE, lv, None, K.ResolverConfig(strategy), K.MemoryConfig("median"), K.MemoryConfig("bruteforce"), threshold, 1)
        for strategy, threshold in (("simple", 0.5), ("best-match", 0.4), ("best-match", 0.99))
    ]
    frames = register.agg(F.max("frame_idx")).first()[0] + 1
    runs = sweep.track_all(rules, PEOPLE, register)
    found = {r.config: r.asDict(True) for r in sweep.summaries(runs, register, "name", sample=3).collect()}
    assert sorted(found) == [0, 1, 2]

    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        if isinstance(value, list):
            return [plain(v) for v in value]
        return repr(round(value, 6)) if isinstance(value, float) else value  # NaN, of 0 / 0, equals itself as text

    for n in found:
        alone = sweep.summary(runs.graph_of(n), register, PEOPLE, frames, "name", sample=3).first().asDict(True)
        assert plain({k: v for k, v in found[n].items() if k != "config"}) == plain(alone)
    assert found[0]["distances"] and found[0]["histogram_record_matchs"]
    one = register.where("frame_idx = 0")
    rows = sweep.summaries(sweep.track_all(rules[:2], PEOPLE, one), one, "name").collect()
    # a run of the simple strategy takes all records of the first frame too
    assert [(r.max, r.distances, r.histogram_record_matchs, r.histogram) for r in rows] == [(1, [], [], [0, one.count()])] * 2


def test_registered_queries_have_rows(spark):
    for name in ("frames_scan", "resolve_best_match", "chain_stats", "start_end_frames", "tracking_end_to_end"):
        assert Q.QUERIES[name](spark, SF).count() > 0
