"""Configuration objects, their defaults and checks."""

from __future__ import annotations

import dataclasses
import os

from kinthread.exceptions import InvalidConfigError
from kinthread.schema import ElementType, RecordSchema

METRICS = ("lv", "lv_opti", "lv_edit", "lv_substring", "lv_multiword")
SCORERS = ("average", "weighted-average", "weighted-quadratic")
STRATEGIES = ("simple", "best-match")
MEMORIES = (
    "bruteforce", "mostfrequent", "median", "ls-bruteforce", "ls-mostfrequent", "ls-median",
    "mw-mostfrequent", "mw-median",
)


def _known(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise InvalidConfigError(f"unknown {what} {value!r}; one of {', '.join(allowed)}")


@dataclasses.dataclass(frozen=True)
class DistanceMetricConfig:
    """A word similarity. ``caching_threshold`` is accepted and has no effect: pairs are always distinct here."""

    metric: str = "lv_opti"
    caching_threshold: int = 4
    use_sigmoid: bool = False
    lv_edit_weights: tuple[float, float, float] | None = None
    lv_substring_weight: float | None = None
    lv_multiword_separator: str | None = None

    def __post_init__(self):
        _known(self.metric, METRICS, "metric")
        if self.lv_edit_weights is not None:
            object.__setattr__(self, "lv_edit_weights", tuple(self.lv_edit_weights))
        if self.metric == "lv_edit" and (self.lv_edit_weights is None or len(self.lv_edit_weights) != 3):
            raise InvalidConfigError("lv_edit needs three lv_edit_weights")
        if self.metric == "lv_substring" and self.lv_substring_weight is None:
            raise InvalidConfigError("lv_substring needs lv_substring_weight")
        if self.metric == "lv_multiword" and not self.lv_multiword_separator:
            raise InvalidConfigError("lv_multiword needs lv_multiword_separator")


@dataclasses.dataclass(frozen=True)
class MemoryConfig:
    """What a tracker remembers of a feature. ``compat_first_memory`` updates the first sub-memory on any match."""

    memory_strategy: str = "median"
    multiword_threshold_match: float | None = None
    multiword_distance_metric: DistanceMetricConfig | None = None
    compat_first_memory: bool = False

    def __post_init__(self):
        _known(self.memory_strategy, MEMORIES, "memory strategy")
        if self.memory_strategy.startswith("mw-") and (
            self.multiword_threshold_match is None or self.multiword_distance_metric is None
        ):
            raise InvalidConfigError("multi-word memories need a threshold and a metric")


@dataclasses.dataclass(frozen=True)
class RecordScorerConfig:
    record_scorer: str = "average"
    weights: tuple[float, ...] | None = None
    min_weight_ratio: float | None = None

    def __post_init__(self):
        _known(self.record_scorer, SCORERS, "record scorer")
        if self.weights is not None:
            object.__setattr__(self, "weights", tuple(self.weights))
        if self.record_scorer != "average" and (self.weights is None or self.min_weight_ratio is None):
            raise InvalidConfigError("weighted scorers need weights and min_weight_ratio")

    def check(self, features: int) -> None:
        if self.weights is not None and len(self.weights) != features:
            raise InvalidConfigError("a scorer needs one weight a feature")


@dataclasses.dataclass(frozen=True)
class ResolverConfig:
    resolving_strategy: str = "best-match"

    def __post_init__(self):
        _known(self.resolving_strategy, STRATEGIES, "resolving strategy")


@dataclasses.dataclass(frozen=True)
class TrackerConfig:
    interest_threshold: float
    limit_no_match_streak: int
    memories: tuple[MemoryConfig, ...]
    record_scorer: RecordScorerConfig

    def __post_init__(self):
        object.__setattr__(self, "memories", tuple(self.memories))


@dataclasses.dataclass(frozen=True)
class TrackingConfig:
    """``num_threads`` is accepted and has no effect: Spark decides the parallelism."""

    num_threads: int
    tracker: TrackerConfig
    distance_metric: DistanceMetricConfig
    resolver: ResolverConfig


@dataclasses.dataclass(frozen=True)
class NormalizationConfig:
    threshold_cluster_match: float
    min_cluster_size: int
    infer_missing_clusters: bool = True
    distance_metric: DistanceMetricConfig = DistanceMetricConfig()


def config(
    record_schema: RecordSchema,
    distance_metric_config: DistanceMetricConfig | None = None,
    record_scorer_config: RecordScorerConfig | None = None,
    resolver_config: ResolverConfig | None = None,
    memory_config: MemoryConfig | None = None,
    multistring_memory_config: MemoryConfig | None = None,
    interest_threshold: float | None = None,
    limit_no_match_streak: int | None = None,
    num_threads: int | None = None,
) -> TrackingConfig:
    """A tracking configuration for the schema; whatever is None takes its default."""
    scorer = record_scorer_config or RecordScorerConfig()
    scorer.check(len(record_schema.fields))
    by_type = {
        ElementType.String: memory_config or MemoryConfig("median"),
        ElementType.MultiStrings: multistring_memory_config or MemoryConfig("mw-median", 0.6, DistanceMetricConfig()),
    }
    return TrackingConfig(
        num_threads or len(os.sched_getaffinity(0)),
        TrackerConfig(
            0.6 if interest_threshold is None else interest_threshold,
            10 if limit_no_match_streak is None else limit_no_match_streak,
            tuple(by_type[f.dtype] for f in record_schema.fields), scorer,
        ),
        distance_metric_config or DistanceMetricConfig(),
        resolver_config or ResolverConfig(),
    )
