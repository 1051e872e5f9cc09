"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the classes' log-count ratios; a linear hinge-loss model on them is fitted by
dual coordinate descent. N-grams are taken of words and of word shapes (letters, capitals, digits and marks in
order, runs as one; a word that repeats the one before it has a shape of its own). A shape n-gram counts by how
much of the text it makes up, in a few steps, so that one odd line isn't a whole odd text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, chunks, hash_each, mixed, rolled, words_of

BITS = 18
SAMPLE = 8_000  #: labelled rows that the fit uses at most; it bounds what the driver holds
STEPS = np.array([0.02, 0.1, 0.3, 0.6])
HELD_OUT = 2


KINDS = re.compile(r"(?P<letters>[^\W\d_A-Z]+)|(?P<capitals>[A-Z]+)|(?P<digits>\d+)|(?P<mark>.)", re.DOTALL)


def _shape(word: str) -> str:
    """a lower-case letters, A capitals, 0 digits, others as they are; runs once."""
    signs = {"letters": "a", "capitals": "A", "digits": "0"}
    out = [("A" if m[0].isupper() else signs[m.lastgroup]) if m.lastgroup in signs else m[0] for m in KINDS.finditer(word)]
    return "".join(c for i, c in enumerate(out) if not i or out[i - 1] != c)


def _shapes(words: pa.Array) -> pa.Array:
    """The shape of each different word (each with its space)."""
    return pa.array([_shape(w[:-1].decode("utf-8", "replace")) for w in words.to_pylist()], pa.string())


def _per_row(words: Words, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each n-gram that lies in one row."""
    owner = words.row_of_word()
    grams = rolled(values, n, n)
    whole = owner[: len(grams)] == owner[len(owner) - len(grams) :] if len(grams) else np.empty(0, bool)
    return owner[: len(grams)][whole], grams[whole]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different (row, feature) of all rows, sorted. A text without words has only the feature 0, as all have."""
    words = words_of(texts)
    ids, different = words.encoded()
    n_rows = len(texts)
    parts = [(np.arange(n_rows), np.zeros(n_rows, np.uint64))]
    if len(words):
        word = hash_each(different)[ids]
        shape = hash_each(_shapes(different))[ids]
        again = np.zeros(len(ids), bool)
        again[1:] = ids[1:] == ids[:-1]
        again[words.rows[:-1][np.diff(words.rows) > 0]] = False
        shape = np.where(again, np.uint64(1), shape)
        parts += [_per_row(words, word, n) for n in (1, 2)]
        total = np.diff(words.rows)
        for n in (1, 2):
            row, gram = _per_row(words, shape, n)
            order = np.lexsort((gram, row))
            row, gram = row[order], gram[order]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))) if len(row) else np.empty(0, np.int64)
            share = np.diff(np.append(new, len(row))) / total[row[new]]
            level = np.searchsorted(STEPS, share, "right")
            for k in range(len(STEPS) + 1):  # at least this much of the text
                at = level >= k
                parts.append((row[new][at], mixed(gram[new][at] + np.uint64(1000 + 10 * n + k))))
    row = np.concatenate([p[0] for p in parts])
    bucket = (np.concatenate([p[1] for p in parts]) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(row * (1 << BITS) + bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class QualityModel:
    """score = 1 / (1 + exp(-(slope * margin + shift)))"""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.weights[feature], minlength=n)

    def score(self, texts: pa.Array) -> np.ndarray:
        row, feature = features(texts)
        margin = self.slope * self.margin(row, feature, len(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int) -> np.ndarray:
    """Weights of the linear hinge-loss model on ratio-scaled indicators, one dual variable at a time. A class's cost
    grows as it is rarer."""
    rng = np.random.default_rng(seed)
    w = np.zeros(len(ratio))
    upper = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    square = np.array([(ratio[r] ** 2).sum() for r in rows]) + 1e-12
    dual = np.zeros(len(rows))
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            slope = y[i] * (w[r] * ratio[r]).sum() - 1
            new = min(max(dual[i] - slope / square[i], 0.0), upper[i])
            if new != dual[i]:
                w[r] += (new - dual[i]) * y[i] * ratio[r]
                largest = max(largest, abs(new - dual[i]))
                dual[i] = new
        if largest < 1e-4:
            break
    return w * ratio


def calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back margins (Newton steps, targets drawn in a little)."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - target) * margin).sum() + 1e-6 * a, (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margin**2).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], label: np.ndarray, smooth: float = 1.0, cost: float = 0.1, rounds: int = 30, least: int = 3, folds: int = 4, seed: int = 5) -> QualityModel:
    """rows: each text's features. Features of fewer than ``least`` texts have no weight. The curve is fitted on
    margins from models that didn't see the text. Fewer than ``folds`` rows of either class, none included, are too few
    for that: a constant score, above 0.5 where label 1 is the more frequent, below where 0 is, 0.5 where neither is."""
    y = np.where(label == 1, 1.0, -1.0)
    width = 1 << BITS
    if (y > 0).sum() < folds or (y < 0).sum() < folds:
        return QualityModel(np.zeros(width), 1.0, 3.0 * float(np.sign(y.sum())) if len(y) else 0.0)

    def weights(at: np.ndarray) -> np.ndarray:
        seen = [np.bincount(np.concatenate([rows[i] for i in at if y[i] == c]), minlength=width) for c in (1.0, -1.0)]
        p, q = seen[0] + smooth, seen[1] + smooth
        n = [(y[at] == c).sum() + 2 * smooth for c in (1.0, -1.0)]
        ratio = np.where(seen[0] + seen[1] >= least, np.log(p / n[0]) - np.log(q / n[1]), 0.0)
        return dual_descent([rows[i] for i in at], y[at], ratio, cost, rounds, seed)

    fold = np.random.default_rng(seed).permutation(len(rows)) % folds
    margin = np.zeros(len(rows))
    for k in range(folds):
        w = weights(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margin[i] = w[rows[i]].sum()
    return QualityModel(weights(np.arange(len(rows))), *calibration(margin, y))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            row, feature = features(part.column("text"))
            offsets = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("quality"), lists], ["quality", "features"])


def _score(batches: Iterator[pa.RecordBatch], model: QualityModel, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(model.score(part.column("text")))], [*names, "score"])


def fold_of(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Learns from at most ``sample`` labelled rows (the smallest hashes of doc_id) whose crc32 mod 4 isn't 2.
    Labels other than 0 and 1, null ids and labels without a document are left out; of an id's repeated labels the
    smaller counts, of its several texts the one of the smaller hash."""
    usable = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & (fold_of("doc_id") != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # so many small rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select("quality", "text", F.xxhash64("doc_id").alias("order"))
    found = rows.orderBy("order").select("quality", "text").mapInArrow(_features_of, "quality int, features array<int>").toArrow()
    if not found.num_rows:
        return fit([], np.empty(0))
    lists = found.column("features").combine_chunks()
    rows = np.split(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).cumsum()[:-1])  # views of one array
    return fit(rows, found.column("quality").to_numpy())


def classify(docs: DataFrame, model: QualityModel, threshold: float = 0.7, *columns: str) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row, after the named other columns.

    Scores come from the whole text alone; null is empty, and empty texts have a score. A model that had fewer than four
    labelled rows of either class (see ``fit``) gives all texts one score. Rows are judged alone: repeated
    rows repeat; a null doc_id stays null and isn't held out. An empty table gives an empty table.
    """
    names = ["doc_id", *columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    scored = docs.select(*names, "text") if "text" not in names else docs.select(*names)
    out = scored.mapInArrow(partial(_score, model=model, names=names), f"{schema}, score double")
    held_out = F.coalesce(fold_of("doc_id") == HELD_OUT, F.lit(False))
    return out.select(*names, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
