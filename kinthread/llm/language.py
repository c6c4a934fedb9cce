"""Language identification: the family first, then one-versus-one linear SVMs within it.

Families are found from the training texts: languages are merged by the
likeness of their mean n-gram profiles. Among families, and among the languages
of a family, each pair has a linear support vector machine with squared hinge
loss; the side with most wins is predicted.
"""

from __future__ import annotations

import dataclasses
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinthread.llm.grams import folded, gram_ids, groups

SIZES = (2, 3)
BITS = 11
#: Training documents of a language, at most, and of all together about (one of each language at least).
PER_LANGUAGE, TOGETHER = 600, 24_000
FOLDS = 5
UNKNOWN = "und"


def profiles(texts) -> np.ndarray:
    """Root-scaled unit n-gram profile of every text, float32."""
    dim = 1 << BITS
    out = np.zeros((len(texts), dim), dtype=np.float32)
    ready = [folded(t if isinstance(t, str) else "") for t in texts]
    for low, high in groups(ready, 1 << 18):
        sizes = np.array([len(x) for x in ready[low:high]])
        data = b"".join(ready[low:high])
        if high - low == 1:
            for at in range(0, len(data), 1 << 20):  # a long text part by part
                for n in SIZES:
                    out[low] += np.bincount(gram_ids(data[at : at + (1 << 20) + n - 1], (n,), BITS), minlength=dim)
            continue
        owner = np.repeat(np.arange(high - low), sizes)
        ids = gram_ids(data, SIZES, BITS)
        # a gram belongs to the text that it begins in; those across a border start in its last bytes
        who = np.concatenate([owner[: len(data) - n + 1] for n in SIZES])
        inside = np.concatenate([owner[: len(data) - n + 1] == owner[n - 1 :] for n in SIZES])
        counts = np.bincount(who[inside] * dim + ids[inside], minlength=(high - low) * dim)
        out[low:high] = counts.reshape(high - low, dim)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights (with a bias at the end) of min decay/2 |w|^2 + mean max(0, 1 - y f)^2, by accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float32)
    y = y.astype(np.float32)
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    decay, rate = np.float32(decay), np.float32(1 / (decay + 4.0))
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = decay * ahead - 2 * ((balance * y * slack) @ x)
        new = ahead - rate * gradient
        ahead = new + np.float32(step / (step + 3)) * (new - w)
        w = new
    return w


def families(centres: np.ndarray, count: int) -> list[list[int]]:
    """Groups of rows: merge the most alike (mean cosine) until ``count`` are left; of ties the first pair."""
    total = centres @ centres.T  # sums over the pairs of two groups
    sizes = np.ones(len(centres))
    parts: list[list[int] | None] = [[i] for i in range(len(centres))]
    mean = np.where(np.triu(np.ones(total.shape, dtype=bool), 1), total, -np.inf)
    for _ in range(len(parts) - count):
        i, j = divmod(int(mean.argmax()), len(parts))
        parts[i], parts[j] = sorted(parts[i] + parts[j]), None
        total[i] += total[j]
        total[:, i] += total[:, j]
        sizes[i] += sizes[j]
        mean[j], mean[:, j] = -np.inf, -np.inf
        for k in [k for k, part in enumerate(parts) if part is not None and k != i]:
            mean[min(i, k), max(i, k)] = total[i, k] / (sizes[i] * sizes[k])
    return [part for part in parts if part is not None]


@dataclasses.dataclass
class OneVersusOne:
    """Pairwise SVMs between groups of labels."""

    size: int
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(winner, confidence) per row; ties go to the larger sum of margins."""
        if self.size == 1 or not len(x):
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        wins = np.zeros((len(x), self.size))
        worst = np.full((len(x), self.size), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            m = margins[:, k]
            wins[:, i] += (m >= 0) + 1e-6 * np.tanh(m)
            wins[:, j] += (m < 0) - 1e-6 * np.tanh(m)
            worst[:, i] = np.minimum(worst[:, i], m)
            worst[:, j] = np.minimum(worst[:, j], -m)
        best = wins.argmax(axis=1)
        return best, 1 / (1 + np.exp(-np.clip(4 * worst[np.arange(len(x)), best], -50, 50)))


def one_versus_one(x: np.ndarray, y: np.ndarray, size: int) -> OneVersusOne:
    pairs = list(itertools.combinations(range(size), 2))
    weights = [
        svm(x[(y == i) | (y == j)], np.where(y[(y == i) | (y == j)] == i, 1.0, -1.0)) for i, j in pairs
    ]
    return OneVersusOne(size, pairs, np.array(weights).reshape(len(pairs), x.shape[1] + 1))


@dataclasses.dataclass
class Model:
    languages: list[str]
    groups: list[list[int]]
    family: OneVersusOne
    within: list[OneVersusOne]

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        x = profiles(texts)
        family, sure = self.family.predict(x)
        label = np.zeros(len(x), dtype=int)
        score = np.zeros(len(x))
        for f, members in enumerate(self.groups):
            mine = np.flatnonzero(family == f)
            won, more = self.within[f].predict(x[mine])
            label[mine] = np.array(members)[won] if len(mine) else 0
            score[mine] = sure[mine] * more
        return [self.languages[i] for i in label], score


def fit(x: np.ndarray, names: list[str]) -> Model:
    languages = sorted(set(names))
    y = np.array([languages.index(n) for n in names])
    centres = np.array([x[y == i].mean(axis=0) for i in range(len(languages))])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    parts = families(centres - centres.mean(axis=0), max(1, round(math.sqrt(len(languages)))))
    part_of = {i: f for f, members in enumerate(parts) for i in members}
    of_family = np.array([part_of[i] for i in y])
    within = []
    for f, members in enumerate(parts):
        mine = of_family == f
        within.append(one_versus_one(x[mine], np.array([members.index(i) for i in y[mine]]), len(members)))
    return Model(languages, parts, one_versus_one(x, of_family, len(parts)), within)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """The model from rows of ``docs`` (doc_id, text, lang) that aren't held out; None without any.

    At most about ``per_language`` documents of a language, and TOGETHER of all,
    chosen by the hash of doc_id, travel to the driver, as profiles of 4 KB: some
    100 MB however many languages there are.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    if not found:
        return None
    per_language = max(1, min(per_language, TOGETHER // len(found)))
    shares = spark.createDataFrame([(r.lang, min(1.0, (1.2 * per_language + 8) / r.n)) for r in found], "lang string, share double")
    place = F.xxhash64("doc_id")
    chosen = rows.join(shares, "lang").where(place.cast("double") / 2.0**64 + 0.5 <= F.col("share"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({
                "lang": part["lang"], "place": part["place"],
                "profile": [p.astype(np.float16).tobytes() for p in profiles(list(part["text"]))],
            })

    got = chosen.select("lang", "text", place.alias("place")).mapInPandas(run, "lang string, place long, profile binary").toPandas()
    got = got.sort_values(["lang", "place", "profile"]).groupby("lang").head(per_language)
    x = np.array([np.frombuffer(p, dtype=np.float16) for p in got["profile"]], dtype=np.float32)
    return fit(x, list(got["lang"]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is
    everything if there was nothing to learn from. Repeated rows and null
    doc_ids keep their rows; other columns are ignored; no rows, no result.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predicted(text: pd.Series) -> pd.DataFrame:
        names, score = [], []
        for at in range(0, len(text), 512):
            got = model.predict(list(text[at : at + 512]))
            names += got[0]
            score.append(got[1])
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate([*score, np.zeros(0)])})

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = rows.select("doc_id", "held_out", letter.alias("letter"), predicted("text").alias("p"))
    return rows.select(
        "doc_id", "held_out",
        F.when(F.col("letter"), F.col("p.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letter"), F.col("p.score")).otherwise(0.0).alias("score"),
    )
