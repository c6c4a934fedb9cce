"""The tracking process: frame after frame, score, resolve, remember."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinthread.config import MemoryConfig, TrackingConfig
from kinthread.functions.memories import CELLS, elements, empty_state, with_cell
from kinthread.log import LOGGER, setup_logger
from kinthread.operators.evaluation import match_histograms
from kinthread.operators.frames import records_of
from kinthread.operators.graph import TrackingGraph
from kinthread.operators.resolution import STEPS, alive, best_match_by_steps, resolve, simple, unmatched_records
from kinthread.operators.scoring import memory_name, score_pairs
from kinthread.operators.word_pairs import WordPairs
from kinthread.runtime import scratch_path, ship
from kinthread.schema import ElementType, RecordSchema


#: What a frame's scoring met.
PAIR_COUNTS = "possible long, met long, kept long, new_words long"


def state_name(i: int) -> str:
    return f"s{i}"


def tracker_id(frame_idx, record_idx):
    """Deterministic id of the tracker that a record begins."""
    return F.shiftleft(frame_idx.cast("long"), 32).bitwiseOR(record_idx)


def cells(schema: RecordSchema, i: int):
    """A record's feature as an array of no or one cell."""
    field = schema.fields[i]
    value = F.array(field.name) if field.dtype is ElementType.String else F.col(field.name)
    return F.when(F.col(field.name).isNull(), F.array().cast(CELLS)).otherwise(F.array(value).cast(CELLS))


def taken(memory: MemoryConfig, state: str, cell: str) -> Column:
    """The state after an array of no or one cell."""
    return F.when(F.expr(f"size({cell}) > 0"), with_cell(memory, state, f"get({cell}, 0)")).otherwise(F.col(state))


def births(records: DataFrame, config: TrackingConfig, schema: RecordSchema, frame_idx: int) -> DataFrame:
    """A tracker for every record."""
    named = records.select(
        "record_idx", *(cells(schema, i).alias(f"c{i}") for i in range(len(schema.fields))), *(empty_state().alias(state_name(i)) for i in range(len(schema.fields))),
    )
    return named.select(
        tracker_id(F.lit(frame_idx), F.col("record_idx")).alias("tracker_id"), F.lit(frame_idx).alias("birth_frame"), F.lit(0).alias("streak"),
        *(taken(m, state_name(i), f"c{i}").alias(state_name(i)) for i, m in enumerate(config.tracker.memories)),
    )


def with_memories(trackers: DataFrame, config: TrackingConfig, schema: RecordSchema) -> DataFrame:
    return trackers.select("*", *(
        elements(m, state_name(i), schema.fields[i].dtype).alias(memory_name(i)) for i, m in enumerate(config.tracker.memories)
    ))


class Tracking:
    """A run; ``step`` takes the next frame's records.

    The state is a table of live trackers: id, streak and a feature's memory
    state (see ``functions.memories``), whose size goes with the distinct values
    that a tracker has met, not with the frames. Tables of the run's history
    (frames, memories, scores, matches) lie in ``folder``, a partition a frame,
    so lineage and plans don't grow with the frames, and nothing is kept on the
    driver but the number of the frame. A frame that is stepped again, after a
    driver was lost, writes its partitions anew. With ``words`` (of the
    configuration's metric) similarities come from that table of word pairs,
    which may outlive the run. Without ``diagnostics`` the run has the same
    chains, but no table of scores: these grow with the square of the records.
    """

    def __init__(self, config: TrackingConfig, schema: RecordSchema, folder: str | None = None, words: WordPairs | None = None, diagnostics: bool = True):
        if len(config.tracker.memories) != len(schema.fields):
            raise ValueError("one memory a feature is needed")
        config.tracker.record_scorer.check(len(schema.fields))
        if words is not None and words.metric != config.distance_metric:
            raise ValueError("the word pairs are of another metric")
        self.config, self.schema, self.words, self.frame_idx = config, schema, words, -1
        self.folder, self.diagnostics = folder.rstrip("/") if folder else None, diagnostics
        self.trackers: DataFrame | None = None

    def _put(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as this frame's part of a table."""
        path = f"{self.folder}/{name}/frame_idx={self.frame_idx}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _table(self, name: str) -> DataFrame:
        """A table of all frames up to this one; with another schema only if nothing was written."""
        spark, path = self.trackers.sparkSession, f"{self.folder}/{name}"
        first = spark.read.parquet(f"{path}/frame_idx={self.frame_idx}").schema
        return spark.read.schema(T.StructType([*first, T.StructField("frame_idx", T.IntegerType())])).parquet(path).where(F.col("frame_idx") <= self.frame_idx)

    def _pairs(self) -> DataFrame | None:
        """(possible, met, kept, new_words, frame_idx)."""
        return self._table("pairs")

    def _scored(self, known: DataFrame, records: DataFrame, threshold: float, **how) -> DataFrame:
        rules = self.config
        return score_pairs(known, records, self.schema, rules.distance_metric, rules.tracker.record_scorer, threshold, words=self.words, **how)

    def _resolved(self, known: DataFrame, records: DataFrame) -> DataFrame:
        """The frame's matches; with diagnostics its scores are stored on the way, and what they met."""
        low, strategy = self.config.tracker.interest_threshold, self.config.resolver.resolving_strategy
        if self.diagnostics:
            counts: dict[str, int] = {}
            scores = self._put("scores", self._scored(known, records, low, counts=counts))
            self._put("pairs", known.sparkSession.createDataFrame([(counts["possible"], counts["met"], scores.count(), counts["new_words"])], PAIR_COUNTS))
            return resolve(scores, strategy)
        if strategy == "simple":
            return simple(self._scored(known, records, low, best=True))
        steps = [step for step in STEPS if step > low]
        return best_match_by_steps(known, records, lambda t, r, step: self._scored(t, r, low if step is None else step), steps)

    def step(self, records: DataFrame) -> None:
        """``records`` (record_idx, features) of the next frame."""
        self.frame_idx += 1
        if self.folder is None:
            self.folder = scratch_path(records.sparkSession, "run")
        schema, tracker, rules = self.schema, self.config.tracker, self.config
        records = self._put("frames", records.select("record_idx", *schema.names))
        if self.trackers is None:
            self.trackers = self._put("trackers", births(records, rules, schema, self.frame_idx))
            return
        columns = ["tracker_id", *(memory_name(i) for i in range(len(schema.fields)))]
        known = self._put("memories", with_memories(self.trackers, rules, schema).select(*columns))
        matches = self._put("matches", self._resolved(known, records).select("tracker_id", "record_idx"))
        new_cells = matches.join(records, "record_idx").select("tracker_id", F.lit(True).alias("matched"), *(cells(schema, i).alias(f"c{i}") for i in range(len(schema.fields))))
        updated = self.trackers.join(new_cells, "tracker_id", "left").select(
            "tracker_id", "birth_frame", F.when(F.col("matched"), 0).otherwise(F.col("streak") + 1).alias("streak"),
            *(taken(m, state_name(i), f"c{i}").alias(state_name(i)) for i, m in enumerate(tracker.memories)),
        )
        state = alive(updated, tracker.limit_no_match_streak)
        if rules.resolver.resolving_strategy == "best-match":
            state = state.union(births(unmatched_records(records, matches), rules, schema, self.frame_idx))
        self.trackers = self._put("trackers", state)
        LOGGER.info("frame %d done", self.frame_idx)

    def restore(self, spark: SparkSession, frame_idx: int) -> None:
        """Take up the run that lies in the folder, as it was after ``frame_idx``."""
        self.frame_idx = frame_idx
        self.trackers = spark.read.parquet(f"{self.folder}/trackers/frame_idx={frame_idx}") if frame_idx >= 0 else None

    def graph(self) -> TrackingGraph:
        """The run so far; its plans are as large for a thousand frames as for two."""
        if self.trackers is None:
            raise ValueError("no frames")
        nodes = self._table("frames").select("frame_idx", "record_idx")
        begun = nodes.where("frame_idx = 0")
        if not self.frame_idx:
            born = begun.select(tracker_id(F.col("frame_idx"), F.col("record_idx")).alias("tracker_id"), "frame_idx", "record_idx")
            return TrackingGraph(born, nodes)
        matches = self._table("matches")
        if self.config.resolver.resolving_strategy == "best-match":
            begun = nodes.join(matches.select("frame_idx", "record_idx"), ["frame_idx", "record_idx"], "left_anti")
        born = begun.select(tracker_id(F.col("frame_idx"), F.col("record_idx")).alias("tracker_id"), "frame_idx", "record_idx")
        chain_nodes = matches.select("tracker_id", "frame_idx", "record_idx").union(born)
        if not self.diagnostics:
            return TrackingGraph(chain_nodes, nodes)
        scores, known = self._table("scores"), self._table("memories")
        memory = known.select(
            "tracker_id", "frame_idx", F.array(*(F.flatten(memory_name(i)) for i in range(len(self.schema.fields)))).alias("memory"),
        )
        counts = match_histograms(scores, known, nodes.where("frame_idx > 0"), ["frame_idx"])
        dense = counts.groupBy("frame_idx").pivot("kind", ["record", "tracker"]).agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))))

        def histogram(kind: str):
            m = F.coalesce(F.col(kind), F.expr("map_from_arrays(array(0L), array(0L))"))
            return F.transform(F.sequence(F.lit(0).cast("long"), F.array_max(F.map_keys(m))), lambda i: F.coalesce(m[i], F.lit(0).cast("long")))

        resolving = dense.select(
            "frame_idx", histogram("record").alias("histogram_record_matchs"), histogram("tracker").alias("histogram_tracker_matchs")
        )
        return TrackingGraph(
            chain_nodes, nodes,
            scores.select("tracker_id", "frame_idx", "record_idx", "score", "distances"), memory, resolving, self._pairs(),
        )


def track(config: TrackingConfig, schema: RecordSchema, records: DataFrame, words: WordPairs | None = None, diagnostics: bool = True) -> TrackingGraph:
    """The graph of a records table (frame_idx, record_idx, features); without ``diagnostics`` its chains and nodes."""
    ship(records.sparkSession)
    top = records.agg(F.max("frame_idx")).first()[0]
    if top is None:
        raise ValueError("no frames")
    run = Tracking(config, schema, words=words, diagnostics=diagnostics)
    for k in range(top + 1):
        run.step(records.where(F.col("frame_idx") == k))
    return run.graph()


def execute_tracking(
    config: TrackingConfig, record_schema: RecordSchema, frames: Sequence[DataFrame], order: Sequence[str], log_level: str = "WARNING",
) -> TrackingGraph:
    """Track entities over a list of tables; ``order`` are columns that put a table's rows in order."""
    setup_logger(log_level)
    return track(config, record_schema, records_of(frames, record_schema, order))
