"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed word starts, fitted in numpy on the driver from
confirmed toxic documents and unlabelled ones, a bounded sample of each, with
the class-prior-corrected risk

    pi * R_P+ + max(0, R_U- - pi * R_P-),

whose negative part is stepped against when it falls below zero. Labelled
harmless documents give the class prior and nothing else. Features are chosen
on the executors; scoring runs there over whole texts.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinthread.llm.common import stored
from kinthread.llm.grams import folded, groups, word_starts, word_starts_by_part

SIZES = (5, 6, 7)
#: Bytes of a very long text that are hashed at once.
PART = 1 << 22
BITS = 20
#: Documents that the classifier is fitted on, at most: toxic and unlabelled ones.
#: Labelled harmless ones stand in for unlabelled ones only where there are none.
POSITIVE, UNLABELLED, NEGATIVE = 2000, 5000, 2000
#: Features of the classifier, at most.
FEATURES = 4096
#: Standard errors by which a feature's share must differ between toxic and unlabelled.
LEAST_Z = 4.0
#: Share of a feature's documents that must be toxic by the prior.
LEAST_SHARE = 0.4
STEPS, RATE, DECAY = 200, 0.05, 1e-5
FOLDS = 5


def value(counts: np.ndarray) -> np.ndarray:
    """What a feature that occurs so often in a text weighs."""
    return np.log2(1.0 + counts)


def size_value(words: np.ndarray) -> np.ndarray:
    """The length feature: a text of more than some 250 words has more of everything."""
    return np.maximum(np.log2(1.0 + words) - 8, 0.0)


@dataclasses.dataclass
class Model:
    """margin = bias + length * size_value(words) + sum of weights * value(count)."""

    ids: np.ndarray
    weights: np.ndarray
    length: float
    bias: float

    def margins(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        pad = b" " * max(SIZES)
        known = np.zeros(1 << BITS, dtype=np.int32)
        known[self.ids] = np.arange(1, len(self.ids) + 1)
        ready = [folded(t if isinstance(t, str) else "") + pad for t in texts]
        for low, high in groups(ready):
            if high - low == 1:
                out[low] += self._margin(ready[low], known)
                continue
            at, grams = word_starts(b"".join(ready[low:high]), SIZES, BITS)
            owner = np.searchsorted(np.cumsum([len(x) for x in ready[low:high]]), at, side="right").astype(np.int64)
            out[low:high] += self.length * size_value(np.bincount(owner, minlength=high - low) / len(SIZES))
            hit = known[grams]
            owner, hit = owner[hit > 0], hit[hit > 0] - 1
            if len(hit):
                pairs, counts = np.unique(owner * len(self.ids) + hit, return_counts=True)
                terms = self.weights[pairs % len(self.ids)] * value(counts)
                out[low:high] += np.bincount(pairs // len(self.ids), weights=terms, minlength=high - low)
        return out

    def _margin(self, text: bytes, known: np.ndarray) -> float:
        """Of one text, a part at a time: what counts of a very long text is small."""
        counts, words = np.zeros(len(self.ids)), 0.0
        for grams in word_starts_by_part(text, SIZES, BITS, PART):
            words += len(grams) / len(SIZES)
            hit = known[grams]
            counts += np.bincount(hit[hit > 0] - 1, minlength=len(self.ids))
        return float(self.length * size_value(words) + (self.weights * value(counts)).sum())

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -50, 50)))


def held_out(doc_id):
    """Rows that no label may be learnt from: CRC-32 of the id's digits divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def counted_grams(text) -> np.ndarray:
    """The text's features as uint64: the gram in the low BITS, its count above."""
    found = [
        np.unique(grams, return_counts=True)
        for grams in word_starts_by_part(folded(text if isinstance(text, str) else ""), SIZES, BITS, PART)
    ]
    ids, counts = found[0]
    if len(found) > 1:
        total = sum(np.bincount(i, weights=c, minlength=1 << BITS) for i, c in found).astype(np.int64)
        ids = np.flatnonzero(total)
        counts = total[ids]
    return ids.astype(np.uint64) | (counts.astype(np.uint64) << np.uint64(BITS))


def _split(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of counted grams."""
    return (grams & np.uint64((1 << BITS) - 1)).astype(np.int64), (grams >> np.uint64(BITS)).astype(np.int64)


def chosen(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, int], float]:
    """((doc_id, kind, grams) of the sample, its rows by kind P, U, N, and the class prior), from rows that aren't held out.

    Documents are chosen by id alone: of a kind with more than its bound those
    whose id has the smallest hash (a filter on the hash keeps about as many,
    the driver cuts the rest). Only then are the chosen texts read, by a
    broadcast of the chosen ids, so texts are never shuffled.
    """
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("mark"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    kind = F.when(F.col("mark") == 1, "P").when(F.col("mark").isNull(), "U").otherwise("N")
    ids = ids.join(marks, "doc_id", "left").select("doc_id", kind.alias("kind"), F.xxhash64("doc_id").alias("place"))
    found = {r.kind: r.n for r in ids.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = {"P": POSITIVE, "U": UNLABELLED, "N": NEGATIVE}
    keep = F.lit(False)
    for name, most in bounds.items():
        share = min(1.0, 1.2 * most / max(1, found.get(name, 0)))
        keep = keep | ((F.col("kind") == name) & (F.col("place").cast("double") / 2.0**64 + 0.5 <= share))
    sizes = dict.fromkeys(bounds, 0)
    picked_ids = []
    for r in sorted(ids.where(keep).collect(), key=lambda r: (r.kind, r.place)):  # about 1.2 of the bounds' sum
        if sizes[r.kind] < bounds[r.kind]:
            sizes[r.kind] += 1
            picked_ids.append((r.doc_id, r.kind))
    key = docs.schema["doc_id"].dataType.simpleString()
    picked = spark.createDataFrame(picked_ids, f"doc_id {key}, kind string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part[["doc_id", "kind"]].assign(grams=[counted_grams(t).astype("<u8").tobytes() for t in part["text"]])

    got = (
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
        .mapInPandas(run, f"doc_id {key}, kind string, grams binary")
        .groupBy("doc_id", "kind").agg(F.min("grams").alias("grams"))
    )
    labelled = found.get("P", 0) + found.get("N", 0)
    prior = min(0.9, max(1e-3, found.get("P", 0) / labelled)) if labelled else 0.1
    return stored(got, "grams"), sizes, prior


#: Values are summed in whole units of this, so that sums don't depend on their order.
UNIT = 1 << 12


def moments(sets) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the features' values, and of their squares, over some texts, in units."""
    sums = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for grams in sets:
        add_moments(sums, grams)
    return sums


def add_moments(sums: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> None:
    ids, counts = _split(grams)
    units = np.rint(value(counts) * UNIT)
    sums[0][ids] += units
    sums[1][ids] += units**2


def strengths(total_p, squares_p, total_u, squares_u, n: int, m: int):
    """(z, log ratio) of features between n toxic and m unlabelled texts."""
    mean_p, mean_u = total_p / UNIT / n, total_u / UNIT / m
    var_p, var_u = squares_p / UNIT**2 / n - mean_p**2, squares_u / UNIT**2 / m - mean_u**2
    z = (mean_p - mean_u) / np.sqrt((var_p + 0.25 / n) / n + (var_u + 0.25 / m) / m)
    return z, np.log(mean_p + 1 / n) - np.log(mean_u + 1 / m + 1 / n)


def telling(z: np.ndarray, ratio: np.ndarray, prior: float) -> np.ndarray:
    """Places of the features to learn with, FEATURES at most: those of the largest z.

    A feature of toxic texts alone is 1 / prior times as frequent in them as in
    unlabelled ones.
    """
    if not len(z):
        return np.zeros(0, dtype=np.int64)
    found = np.flatnonzero((z > min(LEAST_Z, 0.8 * z.max())) & (ratio > np.log(max(1.5, LEAST_SHARE / prior))))
    return np.sort(found[np.argsort(-z[found], kind="stable")[:FEATURES]])


def cells(sets, ids: np.ndarray):
    """(rows, columns, values) of texts' features ``ids``; the last column is the length."""
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[ids] = np.arange(len(ids), dtype=np.int32)
    rows, columns, values = [], [], []
    for row, grams in enumerate(sets):
        own, counts = _split(grams)
        mine = place[own] >= 0
        rows.append(np.full(mine.sum() + 1, row, dtype=np.int32))
        columns.append(np.append(place[own[mine]], np.int32(len(ids))))
        values.append(np.append(value(counts[mine]), size_value(counts.sum() / len(SIZES))))
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (rows, columns, values))


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The margin that parts best: highest F1, which toxic and unlabelled texts tell by themselves at the prior.

    With a recall R among the toxic and a share U of the unlabelled above the
    cut, prior * R of all texts are hits, U are called toxic and prior are.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    recall = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    called = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    f1 = 2 * prior * recall / (prior + called)
    return float(np.mean(cuts[f1 >= f1.max() - 1e-12]))


def learn(ids: np.ndarray, ratio: np.ndarray, matrix, n: int, m: int, prior: float) -> Model:
    """The model over features ``ids`` from cells of n toxic and m unlabelled texts, in this order, by the non-negative risk."""
    rows, columns, values = (np.asarray(x) for x in matrix)
    rows, columns = rows.astype(np.int64), columns.astype(np.int64)
    scale = np.append(np.minimum(ratio, np.log(1 / prior)), 1.0)
    known = np.arange(n + m) < n
    weights, bias = np.append(np.full(len(ids), 0.5), 0.0), float(np.log(prior / (1 - prior)))
    moment, square = np.zeros(len(ids) + 2), np.zeros(len(ids) + 2)
    for step in range(1, STEPS + 1):
        margin = np.bincount(rows, weights=(weights * scale)[columns] * values, minlength=n + m) + bias
        p = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        loss = np.logaddexp(0, margin)
        slope = np.where(known, prior * p / n, -p / m)
        if loss[~known].mean() >= prior * loss[known].mean():  # else only step against the negative part
            slope = np.where(known, -prior / n, p / m)
        gradient = np.append(np.bincount(columns, weights=slope[rows] * values, minlength=len(ids) + 1) * scale + DECAY * weights, slope.sum())
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - change[:-1], bias - change[-1]
    margin = np.bincount(rows, weights=(weights * scale)[columns] * values, minlength=n + m) + bias
    bias -= best_cut(margin[:n], margin[n:], prior)
    return Model(np.asarray(ids, dtype=np.int64), (weights * scale)[:-1], float(weights[-1]), bias)


def nothing() -> Model:
    """A model that calls nothing toxic."""
    return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, -10.0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """The classifier from counted grams; without toxic or unlabelled documents one that calls nothing toxic."""
    n, m = len(positive), len(unlabelled)
    if not n or not m:
        return nothing()
    z, ratio = strengths(*moments(positive), *moments(unlabelled), n, m)
    ids = telling(z, ratio, prior)
    return learn(ids, ratio[ids], cells([*positive, *unlabelled], ids), n, m, prior) if len(ids) else nothing()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Toxic rows are the positives, rows without a label the unlabelled ones (where
    there is none, all that are labelled). Labelled harmless rows give the class
    prior only. What the driver sees are the counts by kind, the chosen ids, and
    of the chosen texts the cells of FEATURES features.
    """
    sample, sizes, prior = chosen(docs, labels)
    n, m = sizes["P"], sizes["U"] or sizes["P"] + sizes["N"]
    if not n or not m:
        return nothing()
    both = sizes["U"] == 0

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {kind: (np.zeros(1 << BITS), np.zeros(1 << BITS)) for kind in ("P", "U")}
        for part in batches:
            for kind, grams in zip(part["kind"], part["grams"], strict=True):
                for name in (["P"] if kind == "P" else []) + (["U"] if kind == "U" or both else []):
                    add_moments(sums[name], np.frombuffer(grams, dtype="<u8"))
        some = np.flatnonzero(sums["P"][0] + sums["U"][0])
        yield pd.DataFrame({"gram": some, **{f"{kind}{i}": s[some].astype(np.int64) for kind, pair in sums.items() for i, s in enumerate(pair)}})

    columns = ["P0", "P1", "U0", "U1"]
    sums = (
        sample.select("kind", "grams").mapInPandas(summed, "gram long, P0 long, P1 long, U0 long, U1 long")
        .groupBy("gram").agg(*(F.sum(c).alias(c) for c in columns))
        # a feature has to be more frequent in toxic texts
        .where(F.col("P0") * float(m) > F.col("U0") * float(n))
    )

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            z, ratio = strengths(*(part[c].to_numpy(np.float64) for c in columns), n, m)
            yield pd.DataFrame({"gram": part["gram"], "z": z, "ratio": ratio})

    measures = stored(sums.mapInPandas(measured, "gram long, z double, ratio double"), "strengths")
    top = measures.agg(F.max("z")).first()[0]
    if top is None:
        return nothing()
    least = np.log(max(1.5, LEAST_SHARE / prior))
    found = (
        measures.where((F.col("z") > min(LEAST_Z, 0.8 * top)) & (F.col("ratio") > float(least)))
        .orderBy(F.desc("z"), "gram").limit(FEATURES).toPandas().sort_values("gram")
    )
    if not len(found):
        return nothing()
    ids = found["gram"].to_numpy(np.int64)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows, columns, values = cells([np.frombuffer(g, dtype="<u8") for g in part["grams"]], ids)
            cuts = np.searchsorted(rows, np.arange(1, len(part)))
            yield part[["doc_id", "kind"]].assign(
                columns=[c.tobytes() for c in np.split(columns.astype("<i4"), cuts)], values=[v.tobytes() for v in np.split(values.astype("<f4"), cuts)]
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    wanted = sample if both else sample.where("kind <> 'N'")
    got = wanted.mapInPandas(told, f"doc_id {key}, kind string, columns binary, values binary").toPandas().sort_values("doc_id")
    positive, rest = got[got["kind"] == "P"], got if both else got[got["kind"] == "U"]
    held = pd.concat([positive, rest])
    columns, values = (b"".join(held[c]) for c in ("columns", "values"))
    rows = np.repeat(np.arange(len(held)), [len(c) // 4 for c in held["columns"]])
    matrix = rows, np.frombuffer(columns, dtype="<i4"), np.frombuffer(values, dtype="<f4").astype(np.float64)
    return learn(ids, found["ratio"].to_numpy(), matrix, len(positive), len(rest), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Whole texts, null ones as empty; an empty text gets the model's base score.
    Repeated rows and null doc_ids keep their rows. Only doc_id and text are
    read; no rows, no result.
    """

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(text)))

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_harmless(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model scores under 0.5, unchanged.

    Every row is judged by its whole text, however long: repeated rows alike,
    null and empty texts as a text without a word. Only text is read; columns
    of any names stay. No rows give none.
    """

    @F.pandas_udf("boolean")
    def harmless(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(text)) < 0.5)

    return docs.where(harmless("text"))
