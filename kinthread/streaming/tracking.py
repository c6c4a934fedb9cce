"""Tracking over a stream: micro-batches of rows that say which frame they belong to.

Matching is global over trackers, so keyed state operators can't do it alone;
``foreachBatch`` runs the same step as the batch plan. Rows are only ever
appended, by batch and frame. A frame is complete once a row of a frame more
than ``delay`` later has come, a watermark on frame_idx; rows of a complete
frame are late, and kept aside.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kinthread.config import TrackingConfig
from kinthread.operators.graph import TrackingGraph
from kinthread.plans.tracking import Tracking
from kinthread.runtime import scratch_path, ship
from kinthread.schema import RecordSchema


class StreamTracker:
    """Feeds a Tracking run from micro-batches of (frame_idx, record_idx, features).

    With ``state``, a folder that outlives the driver, a new tracker with the
    same folder and stream checkpoint goes on where the last one ended; a batch
    that was saved but not committed comes again and is passed over. Without,
    the state is in the shared folder and ends with the driver.

    A frame may come in any number of batches. A record that comes more than
    once counts as it came first (of one batch, by the hash of its row). Rows of
    a frame that was complete before their batch, or of no frame, are late: they
    take no part, and ``late`` has them all.
    """

    def __init__(self, config: TrackingConfig, schema: RecordSchema, state: str | None = None, delay: int = 0):
        self.schema, self.state, self.delay = schema, state.rstrip("/") if state else None, delay
        self.run: Tracking = Tracking(config, schema, state and f"{self.state}/run")
        self.top = self.seen = -1
        self.rows: T.StructType | None = None
        spark = SparkSession.getActiveSession()
        if state and spark:
            self._resume(spark)

    def _resume(self, spark: SparkSession) -> None:
        try:
            versions = [json.loads(r.value) for r in spark.read.text(f"{self.state}/versions/*").collect()]
        except AnalysisException:  # nothing saved yet
            return
        last = max(versions, key=lambda v: v["seen"])
        self.seen, self.top = last["seen"], last["top"]
        self.rows = T.StructType.fromJson(last["rows"])
        self.run.restore(spark, last["frame"])

    def _save(self, spark: SparkSession) -> None:
        line = json.dumps({"seen": self.seen, "top": self.top, "frame": self.run.frame_idx, "rows": self.rows.jsonValue()})
        # written last: a version is whole or isn't there
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.state}/versions/{self.seen}")

    def _arrived(self, spark: SparkSession) -> DataFrame:
        """All rows so far with batch, late (0 or 1) and frame_idx."""
        found = spark.read.schema(self.rows).parquet(f"{self.state}/rows")
        return found.where(F.col("batch") <= self.seen)

    def late(self) -> DataFrame:
        """(frame_idx, record_idx, features, batch) of all rows that came too late, or without a frame."""
        spark = SparkSession.getActiveSession()
        if self.rows is None:
            raise ValueError("no batches")
        return self._arrived(spark).where("late = 1").select("frame_idx", "record_idx", *self.schema.names, "batch")

    def late_counts(self) -> DataFrame:
        """(frame_idx, n) of the late rows."""
        return self.late().groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"))

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.seen:  # a batch that is delivered again
            return
        spark = batch.sparkSession
        if self.state is None:
            self.state = scratch_path(spark, "stream")
        late = F.coalesce((F.col("frame_idx") <= self.run.frame_idx).cast("int"), F.lit(1))
        rows = batch.select("record_idx", *self.schema.names, late.alias("late"), F.col("frame_idx").cast("int").alias("frame_idx"))
        if self.rows is None:
            features = [f for f in rows.schema.fields if f.name not in ("late", "frame_idx")]
            self.rows = T.StructType([*features, *(T.StructField(n, t) for n, t in (("batch", T.LongType()), ("late", T.IntegerType()), ("frame_idx", T.IntegerType())))])
        path = f"{self.state}/rows/batch={batch_id}"
        rows.write.partitionBy("late", "frame_idx").option("compression", "zstd").mode("overwrite").parquet(path)
        self.seen = batch_id
        top = self._arrived(spark).where((F.col("batch") == batch_id) & (F.col("late") == 0)).agg(F.max("frame_idx")).first()[0]
        self.top = max(self.top, -1 if top is None else top)
        self._close_to(spark, self.top - self.delay - 1)
        self._save(spark)

    def _close_to(self, spark: SparkSession, last: int) -> None:
        """Step the run through all frames up to ``last``, those without a row too."""
        while self.run.frame_idx < last:
            k = self.run.frame_idx + 1
            mine = self._arrived(spark).where((F.col("late") == 0) & (F.col("frame_idx") == k))
            first = Window.partitionBy("record_idx").orderBy("batch", F.xxhash64(*self.schema.names))
            self.run.step(mine.withColumn("place", F.row_number().over(first)).where("place = 1").select("record_idx", *self.schema.names))

    def finish(self) -> TrackingGraph:
        """Close the frames still open and return the graph."""
        if self.rows is not None:
            self._close_to(SparkSession.getActiveSession(), self.top)
        return self.run.graph()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        ship(stream.sparkSession)
        return stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
