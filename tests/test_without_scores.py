"""Runs and rankings that store no table of all interesting pairs."""

import os

import pytest
from pyspark.sql import functions as F

from kinthread import queries as Q
from kinthread.config import RecordScorerConfig, ResolverConfig
from kinthread.operators import resolution, scoring
from kinthread.plans import tracking

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def blocks(monkeypatch):
    """Records lie in several blocks, and matching goes by steps."""
    monkeypatch.setattr(scoring, "BROADCAST_RECORDS", 40)
    monkeypatch.setattr(resolution, "AT_ONCE", 1)


@pytest.mark.parametrize("strategy", ["simple", "best-match"])
def test_run_without_diagnostics_has_the_same_chains_and_no_scores(spark, tmp_path, blocks, monkeypatch, strategy):
    monkeypatch.setattr(scoring, "BROADCAST_RECORDS", 4)
    records = Q.frames_table(spark, SMALL).where("frame_idx < 3").cache()
    rules = Q._rules(0.3137, resolver_config=ResolverConfig(strategy))
    run = tracking.Tracking(rules, Q.SCHEMA, str(tmp_path / "run"), diagnostics=False)
    for k in range(3):
        run.step(records.where(F.col("frame_idx") == k))
    graph = run.graph()
    assert not {"scores", "pairs"} & set(os.listdir(tmp_path / "run"))
    assert rows(graph.chain_nodes) == rows(tracking.track(rules, Q.SCHEMA, records).chain_nodes)
    assert graph.diag_records is None


def test_best_of_a_scan_is_one_pair_a_tracker_and_block(spark, blocks):
    records = Q.frames_table(spark, SF).cache()
    # every record twice, so that each best one has an equal
    first, second = Q._first_memories(records, Q.SCHEMA), Q._frame(records, 1)
    twice = second.union(second.withColumn("record_idx", F.col("record_idx") + 1000))
    args = (first, twice, Q.SCHEMA, Q.LV, RecordScorerConfig(), 0.3137)
    found = scoring.score_pairs(*args, best=True).cache()
    assert found.count() <= first.count() * -(-twice.count() // 40)
    assert rows(resolution.simple(found)) == rows(resolution.simple(scoring.score_pairs(*args)))


def test_ranks_are_made_where_scores_are(spark, blocks):
    for query, rank, by in ((Q.rank_records, scoring.rank_records, "record_rank"), (Q.rank_trackers, scoring.rank_trackers, "tracker_rank")):
        found = query(spark, SF)
        expected = Q._rounded(rank(Q._scores(spark, SF)).select("tracker_id", "record_idx", "score", by), "score")
        assert found.dtypes == expected.dtypes
        assert rows(found) == rows(expected)
        plan = found._jdf.queryExecution().toString()
        assert "windowspecdefinition(tracker_id" not in plan and "windowspecdefinition(record_idx" not in plan


def test_mutual_best_goes_by_steps(spark, blocks, monkeypatch):
    asked = []
    by_steps = resolution.best_match_by_steps

    def watched(trackers, records, over, **how):
        return by_steps(trackers, records, lambda t, r, step: asked.append(step) or over(t, r, step), **how)

    monkeypatch.setattr(resolution, "best_match_by_steps", watched)
    found = rows(Q.resolve_mutual_best(spark, SMALL))
    assert asked == [*resolution.STEPS, None]
    assert found == rows(Q._rounded(resolution.mutual_best(Q._scores(spark, SMALL)), "score"))
