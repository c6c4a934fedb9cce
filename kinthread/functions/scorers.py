"""Record scores from per-feature similarities, in float steps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinthread.config import RecordScorerConfig


def _float(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def score(scorer: RecordScorerConfig, similarities: Sequence[Column]) -> Column:
    """float score of a record.

    ``average`` divides by all features, null ones count 0. The weighted forms
    divide by the weight of the features present, at least min_weight_ratio of
    all; the quadratic one squares similarities and takes no root.
    """
    zero = _float(0.0)
    if scorer.record_scorer == "average":
        total = zero
        for s in similarities:
            total = _float(total + F.coalesce(_float(s), zero))
        return _float(total / _float(float(len(similarities))))
    scorer.check(len(similarities))
    total, present, every = zero, zero, 0.0
    for s, w in zip(similarities, scorer.weights, strict=True):
        s = _float(s)
        value = _float(s * s) if scorer.record_scorer == "weighted-quadratic" else s
        total = _float(total + F.coalesce(_float(_float(w) * value), zero))
        present = _float(present + F.when(s.isNotNull(), _float(w)).otherwise(zero))
        every += w
    least = _float(_float(scorer.min_weight_ratio) * _float(every))
    divisor = F.greatest(present, least)
    # an empty record with ratio 0: 0 / 0
    return F.when(divisor == 0, F.lit(float("nan"))).otherwise(total / F.nullif(divisor, zero)).cast("float")


class RowScorer:
    """``score`` of trackers against the same records, a row a tracker, in float32; ``has`` says which records have each feature."""

    def __init__(self, scorer: RecordScorerConfig, has: Sequence[np.ndarray]):
        self.has, self.average, self.square = has, scorer.record_scorer == "average", scorer.record_scorer == "weighted-quadratic"
        weights = [1.0] * len(has) if self.average else scorer.weights
        self.weights = [np.float32(w) for w in weights]
        self.least = None if self.average else np.float32(scorer.min_weight_ratio) * np.float32(sum(weights))
        self.divisors: dict[tuple[bool, ...], np.ndarray | np.float32] = {}

    def _divisor(self, known: tuple[bool, ...]) -> np.ndarray | np.float32:
        """What a tracker's sums are divided by, from which features it knows."""
        if self.average:
            return np.float32(len(self.has))
        if known not in self.divisors:
            weight = np.zeros(len(self.has[0]), dtype=np.float32)
            for there, mine, w in zip(self.has, known, self.weights, strict=True):
                if mine:
                    weight += np.where(there, w, np.float32(0))
            self.divisors[known] = np.maximum(weight, self.least)
        return self.divisors[known]

    def of(self, rows: Sequence[np.ndarray | None]) -> np.ndarray:
        """Scores from a row of similarities a feature, 0 for records without it; None for one that the tracker doesn't know."""
        total = np.zeros(len(self.has[0]), dtype=np.float32)
        for row, w in zip(rows, self.weights, strict=True):
            if row is not None:
                value = row * row if self.square else row
                total += value if w == 1 else value * w
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.divide(total, self._divisor(tuple(row is not None for row in rows)), out=total)


def last_digits(values: np.ndarray, digits: int) -> np.ndarray:
    """Single-precision values in whole units of the last of so many digits, halves away from zero, as doubles: none is so near to a half that a product in doubles could miss it."""
    wide = np.multiply(values, 10.0**digits, dtype=np.float64)
    wide += np.copysign(0.5, wide)
    return np.trunc(wide, out=wide)


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """What Spark's ``round`` makes of single-precision values, as doubles."""
    return last_digits(values, digits) / 10.0**digits


def interesting(score_column: Column, threshold: float) -> Column:
    """Strictly over the threshold, and a number: Spark holds NaN for larger than any."""
    return (score_column > F.lit(threshold).cast("float")) & ~F.isnan(score_column)
