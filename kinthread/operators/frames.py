"""Frames: from tables to one records table and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinthread.schema import ElementType, RecordSchema


def prune(df: DataFrame, schema: RecordSchema, keep: Sequence[str] = ()) -> DataFrame:
    """The schema's columns of ``df`` (after ``keep``), of checked types.

    A missing column or another type is a ValueError at once; a null inside a
    list is an error when the rows are read. Further columns are dropped.
    """
    columns: list[Column] = [F.col(c) for c in keep]
    for field in schema.fields:
        if field.name not in df.columns:
            raise ValueError(f"column {field.name} is missing")
        kind = df.schema[field.name].dataType
        if field.dtype is ElementType.String:
            if not isinstance(kind, T.StringType):
                raise ValueError(f"column {field.name} is {kind.simpleString()}, not string")
            columns.append(F.col(field.name))
        else:
            if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)):
                raise ValueError(f"column {field.name} is {kind.simpleString()}, not array<string>")
            bad = F.raise_error(F.lit(f"null inside a list of {field.name}")).cast("array<string>")
            columns.append(F.when(F.exists(field.name, lambda x: x.isNull()), bad).otherwise(F.col(field.name)).alias(field.name))
    return df.select(*columns)


def number_records(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with record_idx: the place in its frame by ``order``, from 0."""
    place = F.row_number().over(Window.partitionBy("frame_idx").orderBy(*order))
    return df.withColumn("record_idx", (place - 1).cast("long"))


def records_of(frames: Sequence[DataFrame], schema: RecordSchema, order: Sequence[str]) -> DataFrame:
    """(frame_idx, record_idx, features) of a list of frames; frame_idx is the list position.

    ``order`` are columns that put a frame's rows in order: Spark's rows have none.
    """
    if not frames:
        raise ValueError("no frames")
    parts = []
    for i, df in enumerate(frames):
        pruned = prune(df, schema, [c for c in order if c not in schema.names])
        parts.append(pruned.withColumn("frame_idx", F.lit(i)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return number_records(every, order).select("frame_idx", "record_idx", *schema.names)


def frame(records: DataFrame, schema: RecordSchema, frame_idx: int) -> DataFrame:
    """One frame as a table again; null lists become empty ones."""
    return to_frames(records, schema).where(F.col("frame_idx") == frame_idx).drop("frame_idx", "record_idx")


def to_frames(records: DataFrame, schema: RecordSchema) -> DataFrame:
    return records.select("frame_idx", "record_idx", *(
        F.coalesce(f.name, F.array().cast("array<string>")).alias(f.name) if f.dtype is ElementType.MultiStrings else F.col(f.name)
        for f in schema.fields
    ))
