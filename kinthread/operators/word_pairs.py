"""Similarities of distinct word pairs, kept as a table for a whole run or sweep.

Names come back frame after frame, and in every configuration of a sweep. Their
similarities are computed once: pairs of words that the table lacks are found by
an anti-join, computed and appended, and scores are joined from the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinthread.config import DistanceMetricConfig
from kinthread.functions.similarity import similarities
from kinthread.operators.candidates import memory_name
from kinthread.runtime import scratch_path
from kinthread.schema import ElementType, RecordSchema

STORED = "left_word string, right_word string, similarity float, part int"
NOTHING = float("nan")


class WordPairs:
    """The word pairs of one metric, in ``folder`` (a fresh one of the shared folder, if none is given).

    Every call of ``grow`` appends the pairs that are new as one more part. A
    part that a lost driver left unfinished has no committed files, so its pairs
    are simply missing still. One process grows a folder at a time.
    """

    def __init__(self, spark: SparkSession, metric: DistanceMetricConfig, folder: str | None = None):
        self.spark, self.metric = spark, metric
        self.folder = folder.rstrip("/") if folder else scratch_path(spark, "words")

    def table(self) -> DataFrame:
        """(left_word, right_word, similarity, part) of all pairs so far."""
        try:
            return self.spark.read.schema(STORED).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STORED)

    def grow(self, needed: DataFrame) -> int:
        """Compute those of ``needed`` (left_word, right_word; repeats allowed) that the table lacks; returns how many these were."""
        metric, known = self.metric, self.table()
        last = known.agg(F.max("part")).first()[0]
        part = 0 if last is None else last + 1

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = batch["left_word"], batch["right_word"]
                values = similarities(metric, left.to_pylist(), right.to_pylist())
                yield pa.RecordBatch.from_arrays([left, right, pa.array(values, pa.float32())], ["left_word", "right_word", "similarity"])

        new = needed.select("left_word", "right_word").where("left_word IS NOT NULL AND right_word IS NOT NULL").distinct()
        if last is not None:
            new = new.join(known.select("left_word", "right_word"), ["left_word", "right_word"], "left_anti")
        path = f"{self.folder}/part={part}"
        new.mapInArrow(compute, "left_word string, right_word string, similarity float").write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema("left_word string, right_word string, similarity float").parquet(path).count()


def _items(i: int, multi: bool) -> Column:
    """One struct for each word of memory ``m`` and each word of cell ``c`` of feature ``i``; a word that meets an empty list has one without a right word."""
    cell = f"c{i}" if multi else f"array(c{i})"
    return F.expr(f"""
        IF(c{i} IS NULL OR m{i} IS NULL, array(), flatten(flatten(transform(m{i}, (w, e) -> transform(w, (l, at) ->
            transform(IF(size({cell}) = 0, array(CAST(NULL AS STRING)), {cell}), r -> named_struct(
                'feature', {i}, 'element', e, 'at', at, 'words', size(w), 'others', size({cell}), 'left_word', l, 'right_word', r
            )))))))
    """)


def _words(pairs: DataFrame, schema: RecordSchema) -> DataFrame:
    """``pairs`` as a row for every two words that meet in them; a pair in which none meet has one row of nulls."""
    cells = [F.col(memory_name(i)).alias(f"m{i}") for i in range(len(schema.fields))] + [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(schema.fields)]
    every = F.concat(*(_items(i, f.dtype is ElementType.MultiStrings) for i, f in enumerate(schema.fields)))
    return pairs.select("tracker_id", "record_idx", *cells).select("tracker_id", "record_idx", F.explode_outer(every).alias("w")).select("tracker_id", "record_idx", "w.*")


def _best(value: str, when: Column | None = None) -> Column:
    """The largest number; NaN if there are values, none of them a number; null if there are none."""
    v = F.col(value) if when is None else F.when(when, F.col(value))
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.when(F.count(v) > 0, F.lit(NOTHING)))


def joined_similarities(pairs: DataFrame, schema: RecordSchema, words: WordPairs) -> tuple[DataFrame, int]:
    """What ``scoring.pair_similarities`` gives for ``pairs`` (stored ones: they are read twice), through the table; and the number of word pairs that were new.

    Words of a pair of rows are put together again by aggregates that all keep
    the partitioning by tracker and record. A group has no more rows than a
    memory's words times a cell's. Sums are taken word after word, in single
    precision, as there.
    """
    met = _words(pairs, schema)
    new = words.grow(met)
    known = words.table().select("left_word", "right_word", "similarity")
    pair = ["tracker_id", "record_idx"]
    rows = met.join(known, ["left_word", "right_word"], "left").repartition(*pair)
    element = [*pair, "feature", "element", "words", "others"]
    of_words = rows.groupBy(*element, "at").agg(F.coalesce(_best("similarity"), F.lit(0.0)).cast("float").alias("best"))
    of_elements = of_words.groupBy(*element).agg(F.sort_array(F.collect_list(F.struct("at", "best"))).alias("turns"))
    total = F.aggregate("turns", F.lit(0.0).cast("float"), lambda acc, x: (acc + x["best"]).cast("float"))
    lists = [i for i, f in enumerate(schema.fields) if f.dtype is ElementType.MultiStrings]
    mean = (F.col("total") / F.greatest("words", "others").cast("float")).cast("float")
    values = of_elements.withColumn("total", total).withColumn("value", F.when(F.col("feature").isin(lists), mean).otherwise(F.col("total")))
    distances = F.array(*(_best("value", F.col("feature") == i).cast("float") for i in range(len(schema.fields))))
    return values.groupBy(*pair).agg(distances.alias("distances")), new
