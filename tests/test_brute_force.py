"""Whole processes against plain Python over a small table."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinthread import oracle_parts
from kinthread import queries as Q
from kinthread.config import DistanceMetricConfig, MemoryConfig, RecordScorerConfig, ResolverConfig, config
from kinthread.functions.clustering import normalize_multi_words, normalize_words
from kinthread.functions.memories import multi_word, remember
from kinthread.functions import scorers, tables
from kinthread.functions.similarity import pairs_table, quick_rows, quick_table, similarities, similarity_table
from kinthread.functions.words import graphemes
from kinthread.operators import evaluation as E
from kinthread.operators import resolution, scoring
from kinthread.operators.graph import materialize
from kinthread.operators.resolution import tie_of
from kinthread.plans import normalization, sweep, tracking
from kinthread.schema import ElementType, FieldSchema, RecordSchema

SF = "/root/testdata/sf0.001"
RULES = {
    "defaults": config(Q.SCHEMA, interest_threshold=0.5, limit_no_match_streak=1),
    "weighted": config(
        Q.SCHEMA, record_scorer_config=RecordScorerConfig("weighted-quadratic", (0.2, 0.3, 0.3, 0.2), 0.7),
        memory_config=MemoryConfig("ls-mostfrequent"), interest_threshold=0.35, limit_no_match_streak=2,
    ),
}


def best(values):
    numbers = [v for v in values if not math.isnan(v)]
    return max(numbers) if numbers else (np.float32("nan") if values else None)


def similarity(metric, memory, cell, multi):
    if cell is None or not memory:
        return None
    out = []
    for element in memory:
        if not multi:
            out.append(similarities(metric, [element[0]], [cell])[0])
        elif element:
            per_word = [best(list(similarities(metric, [w] * len(cell), list(cell)))) if cell else np.float32(0) for w in element]
            out.append(np.float32(sum(per_word, np.float32(0)) / np.float32(max(len(element), len(cell)))))
    return best(out)


def score(rule, sims):
    if rule.record_scorer == "average":
        return sum((s for s in sims if s is not None), np.float32(0)) / np.float32(len(sims))
    power = 2 if rule.record_scorer == "weighted-quadratic" else 1
    top = sum((np.float32(w) * s**power for w, s in zip(rule.weights, sims, strict=True) if s is not None), np.float32(0))
    present = sum(w for w, s in zip(rule.weights, sims, strict=True) if s is not None)
    return top / max(present, rule.min_weight_ratio * sum(rule.weights))


def slow_track(rules, schema, frames):
    """frames: per frame a list of cell lists; returns chains {id: [(frame, record)]}."""
    kinds = [f.dtype for f in schema.fields]
    live, chains = {}, {}

    def push(history, cells):
        for h, c, kind in zip(history, cells, kinds, strict=True):
            if c is not None:
                h.append((c,) if kind is ElementType.String else tuple(c))

    def birth(k, r, cells):
        history = [[] for _ in kinds]
        push(history, cells)
        live[(k << 32) | r] = [0, history]
        chains[(k << 32) | r] = [(k, r)]

    for r, cells in enumerate(frames[0]):
        birth(0, r, cells)
    for k in range(1, len(frames)):
        pairs = []
        for t, (_, history) in live.items():
            memory = [remember(m, h, kind) for m, h, kind in zip(rules.tracker.memories, history, kinds, strict=True)]
            for r, cells in enumerate(frames[k]):
                s = score(rules.tracker.record_scorer, [
                    similarity(rules.distance_metric, m, c, kind is ElementType.MultiStrings) for m, c, kind in zip(memory, cells, kinds, strict=True)
                ])
                if not math.isnan(s) and np.float32(s) > np.float32(rules.tracker.interest_threshold):
                    pairs.append((-np.float32(s), -tie_of(t, r), t, r))
        taken = {}
        for *_, t, r in sorted(pairs):
            if t not in taken and r not in taken.values():
                taken[t] = r
        for t in list(live):
            if t in taken:
                live[t][0] = 0
                push(live[t][1], frames[k][taken[t]])
                chains[t].append((k, taken[t]))
            else:
                live[t][0] += 1
                if live[t][0] > rules.tracker.limit_no_match_streak:
                    del live[t]
        for r, cells in enumerate(frames[k]):
            if r not in taken.values():
                birth(k, r, cells)
    return chains


@pytest.fixture(scope="module")
def table(spark):
    records = Q.frames_table(spark, SF)
    rows = sorted(records.collect(), key=lambda r: (r.frame_idx, r.record_idx))
    frames = [[[r[n] for n in Q.SCHEMA.names] for r in rows if r.frame_idx == k] for k in range(5)]
    return records, frames


@pytest.mark.parametrize("name", RULES)
def test_tracking_and_normalisation(spark, table, name):
    records, frames = table
    graph = tracking.track(RULES[name], Q.SCHEMA, records)
    found = {}
    for r in graph.chain_nodes.orderBy("tracker_id", "frame_idx").collect():
        found.setdefault(r.tracker_id, []).append((r.frame_idx, r.record_idx))
    assert found == slow_track(RULES[name], Q.SCHEMA, frames)
    assert any(len(c) > 3 for c in found.values())
    if name == "weighted":
        return
    done = {(r.frame_idx, r.record_idx): r for r in normalization.normalize(graph, records, Q.SCHEMA, Q.NORMALIZE).collect()}
    for chain in found.values():
        for i, field in enumerate(Q.SCHEMA.fields):
            values = [frames[k][r][i] for k, r in chain]
            expected = normalize_words(values, Q.NORMALIZE) if field.dtype is ElementType.String else normalize_multi_words(values, Q.NORMALIZE)
            assert [done[node][field.name] for node in chain] == expected
    life = materialize(graph, records, Q.SCHEMA)
    assert life.where("record_idx is not null").count() == sum(map(len, found.values()))


def _words(seed, n, letters="abé", longest=9):
    turn = random.Random(seed)
    return list(dict.fromkeys("".join(turn.choice(letters) for _ in range(turn.randint(0, longest))) for _ in range(n)))


@pytest.mark.parametrize("metric", ["lv", "lv_opti", "lv_substring", "lv_multiword"])
@pytest.mark.parametrize("longest", [7, 14, 30])
def test_tables_of_words_equal_pairs(metric, longest):
    """Lanes of one, two and four bytes, several tiles of columns."""
    rule = DistanceMetricConfig(metric, lv_substring_weight=0.6, lv_multiword_separator="b")
    left, texts = _words(1, 40, longest=longest), tables.Texts(_words(2, 50, longest=longest))
    found, expected = quick_table(rule, left, texts), similarity_table(rule, left, texts.words)
    assert np.array_equal(found, expected, equal_nan=True)


@pytest.mark.parametrize("metric", ["lv", "lv_opti", "lv_substring", "lv_multiword"])
@pytest.mark.parametrize("threshold", [0.35, 0.75])
def test_many_pairs_are_scanned_without_loss(spark, monkeypatch, metric, threshold):
    """Beyond SCANNED no joins of word pieces; the same scores."""
    rule = DistanceMetricConfig(metric, lv_substring_weight=0.6, lv_multiword_separator=" ")
    records = Q.frames_table(spark, "/root/testdata/sf0.001")
    trackers, other = Q._first_memories(records, Q.SCHEMA), Q._frame(records, 1)
    args = (trackers, other, Q.SCHEMA, rule, Q.RecordScorerConfig(), threshold)
    monkeypatch.setattr(scoring, "SCANNED", (1 << 40, 1 << 41))
    joined = {(r.tracker_id, r.record_idx): (r.score, r.distances) for r in scoring.score_pairs(*args, all_pairs=0).collect()}
    monkeypatch.setattr(scoring, "SCANNED", (0, 1 << 41))
    monkeypatch.setattr(scoring, "QUICK", 0)
    monkeypatch.setattr(scoring, "candidates", lambda *_: pytest.fail("joined"))
    scanned = {(r.tracker_id, r.record_idx): (r.score, r.distances) for r in scoring.score_pairs(*args, all_pairs=0).collect()}
    assert joined == scanned


def test_all_pairs_are_dealt_over_tasks(spark):
    """Both sides came in one partition, so one task made all pairs."""
    for name in ("multi_similarity", "score_average"):
        assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_consecutive_sums_in_cells(spark, monkeypatch):
    """F16: totals, pairs and first computations of a grid of many cells; values of several frames."""
    monkeypatch.setattr(E, "CELL", 5)
    frames = [_words(seed, 25, "ab", 4) for seed in range(4)]
    rows = [(k, w) for k, words in enumerate(frames) for w in words if w for _ in range(1 + len(w) % 2)]
    found = {r.frame_idx: (round(r.total, 3), r.pairs, r.computations) for r in E.consecutive_similarity_sums(spark.createDataFrame(rows, "frame_idx int, v string"), "v").collect()}
    seen, expected = set(), {}
    for k in range(3):
        pairs = [(a, b) for i, a in rows if i == k for j, b in rows if j == k + 1]
        like = similarities(DistanceMetricConfig("lv"), [a for a, _ in pairs], [b for _, b in pairs]).astype(float)
        expected[k] = (round(like.sum(), 3), len(pairs), len(set(pairs) - seen))
        seen |= set(pairs)
    assert found == expected


def test_sweeps_scan_without_a_table_of_word_pairs(spark, monkeypatch):
    """the similarities that a scan had were joined anew, word pair by word pair; the same chains."""
    rules = [Q._rules(threshold, limit, resolver_config=ResolverConfig(strategy)) for threshold, limit, strategy in Q.SUMMED]
    records = Q.frames_table(spark, "/root/testdata/sf0.001").where("frame_idx < 3")
    found = {}
    for least in (1 << 40, 0):
        monkeypatch.setattr(scoring, "SCANNED", (least, 1 << 41))
        runs = sweep.track_all(rules, Q.SCHEMA, records)
        found[least] = {tuple(r) for r in runs.chains().collect()}
        assert all((table.table().count() == 0) == (least == 0) for table in runs.tables.values())
    assert found[0] == found[1 << 40] and found[0]


@pytest.mark.parametrize("metric", ["lv", "lv_opti"])
@pytest.mark.parametrize("longest", [7, 14, 40])
def test_bounds_and_single_pairs_of_words(metric, longest):
    """No similarity is over its bound; single pairs are those of the table."""
    rule = DistanceMetricConfig(metric)
    left, texts = _words(1, 40, longest=longest), tables.Texts(_words(2, 50, "abcé", longest))
    table = quick_table(rule, left, texts)
    assert np.all((texts.bounds(left) >= table - 1e-6) | np.isnan(table))
    a, b = (v.reshape(-1) for v in np.indices(table.shape))
    assert np.array_equal(pairs_table(rule, left, texts, a, b), table.reshape(-1), equal_nan=True)


@pytest.mark.parametrize("metric", ["lv", "lv_opti"])
@pytest.mark.parametrize("threshold", [0.35, 0.6137, 0.75])
def test_pairs_that_bounds_leave_are_all(spark, monkeypatch, metric, threshold):
    """Tables of all words were made for pairs that a count of letters rules out; the same scores."""
    records = Q.frames_table(spark, SF)
    born = tracking.with_memories(tracking.births(Q._frame(records, 0), RULES["defaults"], Q.SCHEMA, 0), RULES["defaults"], Q.SCHEMA)
    args = (born, Q._frame(records, 1), Q.SCHEMA, DistanceMetricConfig(metric), RecordScorerConfig(), threshold)
    found = []
    for share, least in ((-1.0, 1024), (1.0, 0), (1.0, 8)):
        monkeypatch.setattr(scoring, "BOUNDED", share)
        monkeypatch.setattr(scoring, "MANY_WORDS", least)
        found.append({(r.tracker_id, r.record_idx): (r.score, r.distances) for r in scoring.score_pairs(*args).collect()})
    assert found[0] == found[1] == found[2] and found[0]


@pytest.mark.parametrize("strategy", ["mw-median", "mw-mostfrequent"])
def test_sql_of_sub_memories_takes_any_number_of_words(strategy):
    """it took the first 16 of a code."""
    groups = {g: [w for w in _words(g, 4 + 12 * g, "abc", 6) if w] for g in range(3)}
    rows = ", ".join(f"({g}, CAST({i} AS BIGINT), '{w}')" for g, words in groups.items() for i, w in enumerate(words, 1))
    sql = f"WITH RECURSIVE spoken(g, ord, word) AS (VALUES {rows}), {oracle_parts.multi_word_memory('spoken', strategy)} SELECT g, memory FROM memory"
    expected = {g: ",".join(multi_word([(w,) for w in words], strategy, DistanceMetricConfig(), 0.6)[0]) for g, words in groups.items()}
    assert dict(duckdb.sql(sql).fetchall()) == expected and len(groups[2]) > 16


@pytest.mark.parametrize("scorer", [RecordScorerConfig(), Q.WEIGHTED, Q.QUADRATIC])
def test_scores_of_all_pairs_are_made_where_their_similarities_are(spark, monkeypatch, scorer):
    """Similarities went to the JVM as lists to be scored and rounded there, pair by pair; the same scores."""
    records = Q.frames_table(spark, SF)
    args = (Q._first_memories(records, Q.STRINGS), Q._frame(records, 1), Q.STRINGS, Q.LV)
    sims = [F.get("distances", i) for i in range(3)]
    expected = scoring.all_similarities(*args).withColumn("score", F.round(scorers.score(scorer, sims).cast("double"), 4))
    expected = {(r.tracker_id, r.record_idx): r.score for r in expected.collect()}
    monkeypatch.setattr(scoring, "score", lambda *_: pytest.fail("scored in the JVM"))
    assert {(r.tracker_id, r.record_idx): r.score for r in scoring.all_scores(*args, scorer, 4).collect()} == expected
    halves = [i / 32 for i in range(33)] + [0.0, float("nan"), 1 / 3]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(halves)], "i int, v float").select("i", F.round(F.col("v").cast("double"), 4).alias("v")).orderBy("i").collect()
    assert np.array_equal(scorers.half_up(np.array(halves, dtype=np.float32), 4), [r.v for r in rows], equal_nan=True)


def test_matching_by_falling_thresholds(spark, monkeypatch):
    """all scores over the lowest threshold were made and ranked; the same matching, and taken trackers are not scored again."""
    expected = {tuple(r) for r in resolution.best_match(Q._scores(spark, "/root/testdata/sf0.01")).select("tracker_id", "record_idx", "score").collect()}
    monkeypatch.setattr(resolution, "AT_ONCE", 0)
    met, plain = [], scoring.score_pairs
    monkeypatch.setattr(scoring, "score_pairs", lambda t, r, *rest: met.append(t.count() * r.count()) or plain(t, r, *rest))
    assert {tuple(r) for r in Q._best_matches(spark, "/root/testdata/sf0.01").select("tracker_id", "record_idx", "score").collect()} == expected
    assert len(met) == 5 and met == sorted(met, reverse=True) and met[-1] < met[0] / 4


@pytest.mark.parametrize("tile", [3, 1 << 15])
def test_edits_of_common_beginnings_or_ends_are_made_once(monkeypatch, tile):
    """Every word took its edits from its first letter on; the same edits, from fewer letters."""
    monkeypatch.setattr(tables, "PREFIX_TILE", tile)
    for alphabet, longest in (("abcé", 12), ("ab", 64), ("ab", 5)):
        words, left = _words(2, 50, alphabet, longest), [*_words(1, 30, alphabet + "z", longest), ""]
        found = tables.Prefixes(words)
        plain = tables.Texts(words)
        expected = np.empty((len(left), len(words)), dtype=np.uint8)
        expected[:, plain.order] = plain.levenshtein([graphemes(w) for w in left])
        assert np.array_equal(found.levenshtein([graphemes(w) for w in left]), expected[:, found.order])
        assert np.array_equal(quick_rows(Q.LV, left, found)(3), similarity_table(Q.LV, left[3:4], found.words)[0], equal_nan=True)
    assert tables.Prefixes(["a" * 65]).levenshtein([("a",)]) is None
    shared = {w: sum(len(letters) for *_, levels in tables.Prefixes(w).tiles for _, letters, _ in levels) for w in (("abcdef1", "abcdef2"), ("1abcdef", "2abcdef"))}
    assert set(shared.values()) == {8}


def _odd_cells(spark):
    """Trackers and records of nulls, empty and long words, several and no elements."""
    cells = [None, "", "a", "ab", "abc" * 30, "aé b"]
    rows = [(i, cells[i % 6], cells[i // 2 % 5], None if i % 5 == 0 else cells[1 : i % 4]) for i in range(13)]
    records = spark.createDataFrame(rows, "record_idx long, x string, y string, z array<string>")
    known = [(100 + i, *([[c]] if c is not None else [] for c in row[1:3]), [row[3], ["ab"]] if row[3] else []) for i, row in enumerate(rows)]
    known += [(200, [["a"], ["ab"], []], [], []), (201, None, [["abc"]], None)]
    trackers = spark.createDataFrame(known, "tracker_id long, m0 array<array<string>>, m1 array<array<string>>, m2 array<array<string>>")
    schema = RecordSchema([FieldSchema("x", ElementType.String), FieldSchema("y", ElementType.String), FieldSchema("z", ElementType.MultiStrings)])
    return trackers, records, schema


@pytest.mark.parametrize("scorer", [RecordScorerConfig(), Q.WEIGHTED, Q.QUADRATIC])
@pytest.mark.parametrize("metric", ["lv", "lv_opti"])
def test_scores_of_odd_cells_come_as_lists(spark, monkeypatch, scorer, metric):
    """Python gave out a row a pair; the same scores from lists, of nulls, empty and long words, several and no elements too."""
    monkeypatch.setattr(scoring, "LISTED", 2)
    trackers, records, schema = _odd_cells(spark)
    args = (trackers, records, schema, DistanceMetricConfig(metric))
    scored = scorers.score(scorer, [F.get("distances", i) for i in range(3)])
    text = lambda rows: {(r.tracker_id, r.record_idx): str(r.score) for r in rows.collect()}
    expected = text(scoring.all_similarities(*args).withColumn("score", F.round(scored.cast("double"), 4)))
    found = scoring.all_scores(*args, scorer, 4)
    assert text(found) == expected and len(expected) == 15 * 13
    assert text(scoring.all_scores(trackers, records.where("false"), *args[2:], scorer, 4)) == {}
    assert "posexplode" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("gap", [False, True])
def test_scores_are_handed_over_in_units(spark, monkeypatch, gap):
    """A record's number and a double were handed over for each pair; the same rows from whole numbers, with records counted where they follow each other."""
    monkeypatch.setattr(scoring, "LISTED", 4)
    monkeypatch.setattr(scoring, "LISTS", 30)
    trackers, records, schema = _odd_cells(spark)
    records = records.where("record_idx != 5") if gap else records.where("record_idx > 2")
    scorer = RecordScorerConfig("weighted-average", (1.0, 2.0, 3.0), 0.0)
    scored = scorers.score(scorer, [F.get("distances", i) for i in range(3)])
    text = lambda rows: {(r.tracker_id, r.record_idx): str(r.score) for r in rows.collect()}
    expected = text(scoring.all_similarities(trackers, records, schema, Q.LV).withColumn("score", F.round(scored.cast("double"), 4)))
    found = scoring.all_scores(trackers, records, schema, Q.LV, scorer, 4)
    assert text(found) == expected and "nan" in expected.values() and len(set(expected.values())) > 5
    assert "first#" in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="6 digits"):
        scoring.all_scores(trackers, records, schema, Q.LV, scorer, 7)


@pytest.mark.parametrize("scorer", [RecordScorerConfig(), Q.WEIGHTED])
def test_rows_of_trees_leave_what_tables_leave(spark, monkeypatch, scorer):
    """bounds were made of all pairs, and similarities of those left; exact rows give the same scores and distances."""
    monkeypatch.setattr(scoring, "SCANNED", (0, 1 << 38))
    records = Q.frames_table(spark, SF)
    rules = RULES["defaults"]
    born = tracking.with_memories(tracking.births(Q._frame(records, 0), rules, Q.SCHEMA, 0), rules, Q.SCHEMA)
    text = lambda rows: {(r.tracker_id, r.record_idx): str((r.score, r.distances)) for r in rows.collect()}
    made = [(*_odd_cells(spark), scorer, 0.3)]
    if scorer.record_scorer == "average":
        made.append((born, Q._frame(records, 1), Q.SCHEMA, scorer, 0.6137))
    for trackers, some, schema, rule, threshold in made:
        args = (trackers, some, schema, Q.LV, rule, threshold)
        with monkeypatch.context() as plain:
            plain.setattr(scoring, "nested_rows", scoring.nested_loop)
            expected = text(scoring.score_pairs(*args))
        with monkeypatch.context() as rows:
            rows.setattr(scoring, "nested_loop", lambda *_: pytest.fail("bounds of all pairs"))
            assert text(scoring.score_pairs(*args)) == expected and expected
