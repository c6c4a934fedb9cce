"""Record tracking and entity resolution over ordered tables, on Spark.

Frames (one table per time step) are scored against the entities seen so far,
matched one to one, and remembered as chains; chains can be materialised,
evaluated, normalised and stored. Everything is DataFrames in, DataFrames out.
"""

from kinthread.config import (
    DistanceMetricConfig,
    MemoryConfig,
    NormalizationConfig,
    RecordScorerConfig,
    ResolverConfig,
    TrackerConfig,
    TrackingConfig,
    config,
)
from kinthread.exceptions import InvalidConfigError, InvalidSchemaError, InvalidStoreError, KinthreadError
from kinthread.schema import ElementType, FieldSchema, RecordSchema

__all__ = [
    "DistanceMetricConfig", "ElementType", "FieldSchema", "InvalidConfigError", "InvalidSchemaError", "InvalidStoreError",
    "KinthreadError", "MemoryConfig", "NormalizationConfig", "RecordSchema", "RecordScorerConfig",
    "ResolverConfig", "TrackerConfig", "TrackingConfig", "config",
]
