"""The tracking graph as tables: edges, chains, materialised chains."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinthread.schema import RecordSchema


def _chain(by: Sequence[str] = ()):
    return Window.partitionBy(*by, "tracker_id").orderBy("frame_idx")


@dataclasses.dataclass
class TrackingGraph:
    """Chains and diagnostics of a tracking run.

    chain_nodes (tracker_id, frame_idx, record_idx); nodes (frame_idx,
    record_idx), matched or not; diag_records (tracker_id, frame_idx,
    record_idx, score, distances); diag_memory (tracker_id, frame_idx, memory);
    diag_resolving (frame_idx, histogram_record_matchs, histogram_tracker_matchs);
    diag_pairs (possible, met, kept, new_words, frame_idx).
    """

    chain_nodes: DataFrame
    nodes: DataFrame
    diag_records: DataFrame | None = None
    diag_memory: DataFrame | None = None
    diag_resolving: DataFrame | None = None
    diag_pairs: DataFrame | None = None

    @property
    def trackers_ids(self) -> DataFrame:
        """(tracker_id) of all chains, in order."""
        return self.chain_nodes.select("tracker_id").distinct().orderBy("tracker_id")

    def tracker_diagnostics(self, tracker_id: int) -> DataFrame:
        """(frame_idx, memory, records) of one tracker."""
        mine = self.diag_records.where(F.col("tracker_id") == tracker_id).groupBy("frame_idx").agg(
            F.sort_array(F.collect_list(F.struct("record_idx", "score", "distances"))).alias("records")
        )
        return self.diag_memory.where(F.col("tracker_id") == tracker_id).drop("tracker_id").join(mine, "frame_idx", "left")

    def materialize_tracking_chain(
        self, tracker_id: int, records: DataFrame, schema: RecordSchema, normalized: DataFrame | None = None
    ) -> MaterializedChain:
        """One chain with its records, for every frame of the tracker's life."""
        chain = self.chain_nodes.where(F.col("tracker_id") == tracker_id)
        if chain.isEmpty():
            raise ValueError(f"no tracker {tracker_id}")
        return MaterializedChain(materialize(self, records, schema, normalized).where(F.col("tracker_id") == tracker_id), schema)


@dataclasses.dataclass
class MaterializedChain:
    frames: DataFrame
    schema: RecordSchema

    @property
    def matched_frames(self) -> DataFrame:
        return self.frames.where("record_idx is not null").orderBy("frame_idx")

    @property
    def length(self) -> int:
        """Matched frames."""
        return self.matched_frames.count()

    @property
    def lifespan(self) -> int:
        """Frames from the first match to the last; 0 without a match."""
        first, last = self.matched_frames.agg(F.min("frame_idx"), F.max("frame_idx")).first()
        return 0 if first is None else last - first + 1

    def as_dataframe(self, normalized: bool = False) -> DataFrame:
        """The matched rows' features, or their normalised ones."""
        side = "normalized" if normalized else "record"
        if side not in self.frames.columns:
            raise ValueError("the chain was made without normalised records")
        return self.matched_frames.select("frame_idx", f"{side}.*")


def materialize(graph: TrackingGraph, records: DataFrame, schema: RecordSchema, normalized: DataFrame | None = None) -> DataFrame:
    """(tracker_id, frame_idx, record_idx, record, [normalized], memory) of all chains, a row per frame of a tracker's life.

    Frames without a match have no record; the birth frame has no diagnostics.
    """
    key = ["frame_idx", "record_idx"]
    life = graph.chain_nodes.select("tracker_id", "frame_idx")
    if graph.diag_memory is not None:
        life = life.union(graph.diag_memory.select("tracker_id", "frame_idx")).distinct()
    out = life.join(graph.chain_nodes, ["tracker_id", "frame_idx"], "left")
    out = out.join(records.select(*key, F.struct(*schema.names).alias("record")), key, "left")
    if normalized is not None:
        out = out.join(normalized.select(*key, F.struct(*schema.names).alias("normalized")), key, "left")
    if graph.diag_memory is not None:
        out = out.join(graph.diag_memory, ["tracker_id", "frame_idx"], "left")
    return out.select("tracker_id", *key, *(c for c in ("record", "normalized", "memory") if c in out.columns))


def edges(chain_nodes: DataFrame) -> DataFrame:
    """(tracker_id, from_frame, from_record, to_frame, to_record) of successive nodes."""
    node = F.struct("frame_idx", "record_idx")
    found = chain_nodes.withColumn("next", F.lead(node).over(_chain())).where("next is not null")
    return found.select(
        "tracker_id", F.col("frame_idx").alias("from_frame"), F.col("record_idx").alias("from_record"),
        F.col("next.frame_idx").alias("to_frame"), F.col("next.record_idx").alias("to_record"),
    )


def with_positions(chain_nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """chain_nodes with pos (from 0) and whether the node comes in and goes out; ``by`` are columns that tell runs apart."""
    return chain_nodes.select(
        "*", (F.row_number().over(_chain(by)) - 1).alias("pos"),
        F.lag("frame_idx").over(_chain(by)).isNotNull().alias("comes_in"),
        F.lead("frame_idx").over(_chain(by)).isNotNull().alias("goes_out"),
    )


def dereference(chain_nodes: DataFrame, records: DataFrame) -> DataFrame:
    """chain_nodes with their records' columns."""
    return chain_nodes.join(records, ["frame_idx", "record_idx"])


def chain_of(chain_nodes: DataFrame, tracker_id: int) -> DataFrame:
    return chain_nodes.where(F.col("tracker_id") == tracker_id).orderBy("frame_idx")


def chains_at_least(chain_nodes: DataFrame, length: int, start: int | None = None) -> DataFrame:
    """(tracker_id, length) of chains of at least ``length`` nodes; with ``start`` the first id from there on."""
    found = chain_nodes.groupBy("tracker_id").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") >= length)
    if start is None:
        return found
    return found.where(F.col("tracker_id") >= start).orderBy("tracker_id").limit(1)


def sample_ids(chain_nodes: DataFrame, n: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """(by, tracker_id) of n chains of each run, all if fewer: those of the smallest seeded MD5."""
    ids = chain_nodes.select(*by, "tracker_id").distinct()
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("tracker_id").cast("string"))), F.col("tracker_id")
    if not by:
        return ids.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))  # cut to n a task before the shuffle
    return ids.withColumn("place", place).where(F.col("place") <= n).drop("place")
