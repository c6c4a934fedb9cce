"""Helpers shared by the training-data operators: words, sizes, components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinthread.runtime import scratch_path, shared_dir, stored

__all__ = ["SALTS", "SPACE", "WORD", "connected_components", "give_back", "input_bytes", "row_hash", "scratch_path", "shared_dir", "spread_join", "stored"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Parts that the rows of one key are split into where a key may hold most rows.
SALTS = 64


def give_back() -> None:
    """Freed memory of this worker goes back to the system.

    A worker outlives its task, and the C library keeps what was freed: workers
    that wait would hold it beside those that work.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def input_bytes(docs: DataFrame) -> int:
    """Bytes behind ``docs``: Catalyst's estimate (file sizes for scans), or else the texts' sum."""
    found = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if found >= 1 << 50:  # no estimate
        found = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return found


def row_hash(df: DataFrame):
    """A 64-bit hash of a row's columns, of any types (maps, which Spark doesn't hash, as JSON)."""
    return F.xxhash64(*(
        F.to_json(F.struct(name)) if "map<" in kind or "variant" in kind else F.col(name) for name, kind in df.dtypes
    ))


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` (with ``salt``) joined to ``table``, which has one row a ``key``, without a hot key.

    A key's row is copied to the salts that occur with it in ``rows``, at most
    SALTS, so no task gets all rows of a key. ``salt`` must be a stored column.
    """
    places = rows.select(F.col(key).alias("of"), F.col("salt").alias("at")).distinct()
    spread = table.join(places, F.col(key) == F.col("of")).drop("of").withColumnRenamed("at", "salt")
    return rows.join(spread, [key, "salt"], how)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): component is its smallest node.

    Alternates the large-star and small-star steps until no edge changes
    (O(log^2 n) rounds). Each round is joins and partial aggregations on the
    node, so a hub is pre-aggregated and its join partition can be split; the
    lineage is cut every round. Null ends and loops are ignored.
    """
    edges = stored(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = stored(small, "edges")
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
