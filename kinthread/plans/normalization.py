"""Normalisation of records along their chains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinthread.config import NormalizationConfig
from kinthread.functions.clustering import normalize_multi_words, normalize_words
from kinthread.operators.frames import to_frames
from kinthread.operators.graph import TrackingGraph, dereference
from kinthread.runtime import ship
from kinthread.schema import ElementType, RecordSchema


def normalized_chains(chain_nodes: DataFrame, records: DataFrame, schema: RecordSchema, rules: NormalizationConfig) -> DataFrame:
    """(tracker_id, frame_idx, record_idx, features): every node with its chain's normalised values.

    A chain is a row per frame at most, so a group is small whatever the table.
    """
    names = schema.names
    multi = [f.dtype is ElementType.MultiStrings for f in schema.fields]

    def run(chain: pd.DataFrame) -> pd.DataFrame:
        chain = chain.sort_values("frame_idx").reset_index(drop=True)
        for name, lists in zip(names, multi, strict=True):
            values = [None if v is None else v for v in chain[name]]
            chain[name] = pd.Series(normalize_multi_words(values, rules) if lists else normalize_words(values, rules), dtype=object)
        return chain

    nodes = dereference(chain_nodes, records).select("tracker_id", "frame_idx", "record_idx", *names)
    return nodes.groupBy("tracker_id").applyInPandas(run, nodes.schema)


def normalize(graph: TrackingGraph, records: DataFrame, schema: RecordSchema, rules: NormalizationConfig) -> DataFrame:
    """records with normalised features; rows in no chain stay, of several chains the largest id's is taken."""
    ship(records.sparkSession)
    key = ["frame_idx", "record_idx"]
    done = normalized_chains(graph.chain_nodes, records, schema, rules)
    done = done.groupBy(*key).agg(F.max_by(F.struct(*schema.names), "tracker_id").alias("new"))
    out = to_frames(records.select(*key, *schema.names), schema).join(done, key, "left")
    return out.select(*key, *(
        F.when(F.col("new").isNull(), F.col(n)).otherwise(F.col(f"new.{n}")).alias(n) for n in schema.names
    ))


def execute_normalization(config: NormalizationConfig, record_schema: RecordSchema, graph: TrackingGraph, records: DataFrame) -> DataFrame:
    """The normalised records table (frame_idx, record_idx, features)."""
    return normalize(graph, records, record_schema, config)
