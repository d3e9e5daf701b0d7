"""Ordinal quality grades by cumulative-link regression on hashed text features.

A text's distinct lower-cased words and runs of marks, and bins of a few of its shares (capitals, symbols, bars, word
length), are hashed into a fixed number of weights, shared by all grades.  With ordered thresholds
t1 < t2 the model is P(grade >= k) = sigmoid(weights . features - tk).  The expected grade is the
sum of these tail probabilities, and a tail probability selects.

Fitting takes a bounded sample of the labelled rows (`sample` rows at most, those with the least
hash of their id) and runs full-batch Adam steps on hashed feature numbers in one task; a weight
needs `least_rows` rows of the sample.  Scoring reads every document.

Cases: a null text counts as empty and has only the shares' features; labels with a null are not
used; without usable labels every document has the highest grade for sure; repeated rows and labels
count each; a probability at the bound keeps a document; texts of any length are read in whole; an empty
table gives no rows; `good` passes all columns through, whatever their names but `__expected` and `__tails`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import column_values, map_arrow

BUCKETS = 1 << 22
SAMPLE = 12_000
LEAST_ROWS = 4
STEPS = 200
RATE = 0.05
RIDGE = 1.2  # the prior's precision: its share of the mean loss falls with the rows
WORDS_KEPT = 100_000
WORD = re.compile(r"\w+")
MARKS = re.compile(r"[^\w\s]+")
SYMBOLS = re.compile(r"[^\w\s.,;:'\"()-]")


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "replace")) % BUCKETS


def shares(text: str, words: int) -> list[str]:
    """One feature for the bin of each share."""
    size = max(1, len(text))
    letters = sum(map(text.count, "|!%$#&*"))
    capitals = len(text) - len(re.sub(r"[A-ZÀ-Ö]", "", text)) if size < 1 << 16 else sum(c.isupper() for c in text)
    numbers = {"symbol": len(SYMBOLS.findall(text)) / size, "mark": letters / size, "bar": text.count("|") / size, "capital": capitals / size, "length": words / 1000, "word": size / max(1, words) / 100}
    return [f"\0{name}:{min(9, int(math.log2(1 + 1000 * value)))}" for name, value in numbers.items()]


def features(text: str) -> set[str]:
    """The distinct features of a text."""
    words = WORD.findall(text.lower())
    return {*words, *MARKS.findall(text), *shares(text, len(words))}


@dataclass
class Model:
    """Weights by bucket (index, value) and thresholds."""

    index: np.ndarray
    value: np.ndarray
    thresholds: list[float]


def fit_ordinal(offsets: np.ndarray, columns: np.ndarray, grades: np.ndarray, levels: int, steps: int = STEPS, least_rows: int = LEAST_ROWS) -> Model:
    """Fit to rows of bucket numbers (`columns`, cut at `offsets`) with grades 0 to levels - 1."""
    used = np.flatnonzero(np.bincount(columns, minlength=BUCKETS) >= least_rows)
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    column = number[columns]
    row = np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(offsets))[column >= 0]
    column = column[column >= 0]
    tails = np.array([(np.sum(grades >= k) + 1) / (len(grades) + 2) for k in range(1, levels)])
    theta = np.concatenate([[-math.log(tails[0] / (1 - tails[0]))], np.zeros(levels - 2)])
    theta[1:] = np.log(np.maximum(0.05, np.diff(-np.log(tails / (1 - tails)))))
    point = np.concatenate([np.zeros(len(used)), theta])  # thresholds are the first and the logarithms of the gaps
    first, second = np.zeros_like(point), np.zeros_like(point)
    n = len(grades)
    for step in range(1, steps + 1):
        weights, base, gaps = point[: len(used)], point[len(used)], np.exp(point[len(used) + 1 :])
        cuts = np.concatenate([[base], base + np.cumsum(gaps)])
        score = np.bincount(row, weights[column], n)
        tail = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30))), np.zeros((n, 1))], 1)
        slope = tail * (1 - tail)
        own = np.maximum(tail[np.arange(n), grades] - tail[np.arange(n), grades + 1], 1e-9)
        up, down = slope[np.arange(n), grades] / own, slope[np.arange(n), grades + 1] / own
        by_score = (up - down) / n
        by_cut = np.array([-(up[grades == k].sum() - down[grades == k - 1].sum()) / n for k in range(1, levels)])
        by_gap = np.array([by_cut[k:].sum() for k in range(1, levels - 1)]) * gaps
        gradient = -np.concatenate([np.bincount(column, by_score[row], len(used)), [by_cut.sum()], by_gap])
        gradient[: len(used)] += RIDGE / n * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        point = point - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    base, gaps = point[len(used)], np.exp(point[len(used) + 1 :])
    return Model(used, point[: len(used)], [float(base), *(base + np.cumsum(gaps)).tolist()])


def fit(docs: DataFrame, grades: DataFrame, levels: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model | None:
    """Fit to the documents' texts with the grades (id, grade) of their ids; None without usable rows.

    The sample's ids are chosen first, and only their texts are read into features; they are
    `sample` at most, which bounds what is broadcast and the one task that fits.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = [np.sort(np.fromiter({bucket(f) for f in features(t)}, np.int32)).tobytes() for t in column_values(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["_id", "_grade", "_columns"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = sorted((r["_id"], min(levels - 1, max(0, r["_grade"])), r["_columns"]) for batch in batches for r in batch.to_pylist())
        if rows:
            parts = [np.frombuffer(r[2], np.int32) for r in rows]
            model = fit_ordinal(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts), np.array([r[1] for r in rows]), levels)
            values = (model.index.astype(np.int64).tobytes(), model.value.tobytes(), np.array(model.thresholds).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["index", "value", "thresholds"])

    rated = grades.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(grade_col).cast("int").alias("_grade"))
    known = rated.join(docs.select(F.col(id_col).cast("long").alias("_id")), "_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = map_arrow(texts.join(F.broadcast(chosen), "_id").select("_id", "_grade", "_text"), "_id long, _grade int, _columns binary", read)
    found = map_arrow(rows.repartition(1), "index binary, value binary, thresholds binary", learn).collect()
    return Model(np.frombuffer(found[0][0], np.int64), np.frombuffer(found[0][1], np.float64), np.frombuffer(found[0][2], np.float64).tolist()) if found else None


def grade(docs: DataFrame, model: Model | None, levels: int, text_col: str = "text") -> DataFrame:
    """The documents with `__expected` (the expected grade) and `__tails` (P(grade >= k) for k from 1) added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most one weight for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = shared.value
        weights: dict[str, tuple[int, float] | bool] = {}
        table = dict(zip(own.index.tolist(), own.value.tolist())) if own else {}
        for batch in batches:
            expected, tails = [], []
            for text in column_values(batch, text_col):
                if own is None:
                    expected.append(float(levels - 1)), tails.append([1.0] * (levels - 1))
                    continue
                if len(weights) > WORDS_KEPT:
                    weights.clear()
                buckets = {}
                for f in features(text or ""):
                    w = weights.get(f)
                    if w is None:
                        w = weights[f] = (b, table[b]) if (b := bucket(f)) in table else False
                    if w:
                        buckets[w[0]] = w[1]
                score = math.fsum(buckets.values())
                tail = [1 / (1 + math.exp(-max(-30.0, min(30.0, score - t)))) for t in own.thresholds]
                expected.append(math.fsum(tail)), tails.append(tail)
            yield batch.append_column("__expected", pa.array(expected, pa.float64())).append_column("__tails", pa.array(tails, pa.list_(pa.float64())))

    return map_arrow(docs, T.StructType([*docs.schema.fields, T.StructField("__expected", T.DoubleType()), T.StructField("__tails", T.ArrayType(T.DoubleType()))]), run)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Graded rating of a label: 0 toxic, 1 of low quality, 2 good; null if neither is known."""
    return F.when(toxic > 0, 0).when(quality <= 0, 1).when(quality > 0, 2)


LEVELS = 3
KEEP_TAIL = 0.5


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the labels' grades."""
    return fit(docs, labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")), LEVELS, sample)


def good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose tail probability of the highest grade is at least KEEP_TAIL; all columns, no shuffle."""
    graded = grade(docs, fit_documents(docs, labels, sample), LEVELS)
    return graded.where(F.col("__tails")[LEVELS - 2] >= KEEP_TAIL).drop("__expected", "__tails")


def grade_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labels' documents and grade all: doc_id, expected_grade, p_not_toxic, p_good, keep (p_good >= 0.5)."""
    tails = F.col("__tails")
    graded = grade(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_documents(docs, labels, sample), LEVELS)
    return graded.select("doc_id", F.col("__expected").alias("expected_grade"), tails[0].alias("p_not_toxic"), tails[1].alias("p_good"), (tails[1] >= KEEP_TAIL).alias("keep"))
