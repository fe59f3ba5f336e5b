"""Toxicity: cumulative-link ordinal regression on sparse word features, giving an expected severity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, small, written

#: Labelled documents that the model is fitted on at most: those whose ids hash lowest; and bytes of their words' hashes, for
#: the driver holds those (8 bytes for each distinct word of a document).
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 20_000, 48 << 20
#: Words that have a weight at most, those most associated with the label: a parameter of the model, like its penalty.
MAX_FEATURES = 50_000
HELD_OUT = 5
GRADES = 3
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct runs of letters, in lower case."""
    return set(_WORDS.findall((text or "").lower()))


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(sum of weights of the distinct words - cut k): weights shared, cuts ordered."""

    weights: dict[str, float]
    cuts: list[float]
    threshold: float
    held_out: dict[str, float]

    def expected(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of grade >= 1, and the expected grade."""
        w, known = self.weights, self.weights.keys()
        eta = np.fromiter((sum(w[x] for x in known & words_of(t)) for t in texts), np.float64, len(texts))
        p = _sigmoid(eta[:, None] - np.array(self.cuts))
        return p[:, 0], p.sum(1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Sparse:
    """Rows of feature numbers, with a few products."""

    def __init__(self, rows: list[np.ndarray], n: int):
        self.index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.length = np.fromiter(map(len, rows), np.int64, len(rows))
        self.row = np.repeat(np.arange(len(rows)), self.length)
        self.n = n

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], len(self.length))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, g[self.row], self.n)


def fit_ordinal(x: Sparse, grade: np.ndarray, steps: int = 250, l1: float = 2e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by proximal Adam on the mean negative log-likelihood with an L1 penalty."""
    w, gaps = np.zeros(x.n), np.array([2.0] + [0.5] * (GRADES - 1))
    m = [np.zeros(x.n), np.zeros(GRADES)]
    s = [np.zeros(x.n), np.zeros(GRADES)]
    rows = np.arange(len(grade))
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        eta = x.dot(w)
        f = np.concatenate([np.zeros((len(eta), 1)), _sigmoid(cuts - eta[:, None]), np.ones((len(eta), 1))], 1)  # P(grade < k)
        low, high = f[rows, grade], f[rows, grade + 1]
        p = np.maximum(high - low, 1e-9)
        g_eta = (1 - low - high) / len(eta)
        g_cut = np.zeros(GRADES)
        np.add.at(g_cut, np.minimum(grade, GRADES - 1), np.where(grade < GRADES, -(high * (1 - high)) / p, 0) / len(eta))
        np.add.at(g_cut, np.maximum(grade - 1, 0), np.where(grade > 0, (low * (1 - low)) / p, 0) / len(eta))
        after = np.cumsum(g_cut[::-1])[::-1]  # a gap moves its cut and all later ones
        grads = [x.back(g_eta), np.concatenate([after[:1], after[1:] * np.exp(gaps[1:])])]
        for i, (value, g) in enumerate(zip((w, gaps), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            step = rate / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)
            value -= step * m[i] / (1 - 0.9**t)
            if i == 0:
                value[:] = np.sign(value) * np.maximum(np.abs(value) - np.minimum(step * l1, rate), 0)
    return w, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = [np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in words_of(t)), np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(list(map(len, rows)), pa.int64())], ["doc_id", "toxic", "words", "n"])


def _spelled(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = wanted.value
        for batch in small(batches):
            found = {w: h for t in batch.column("text").to_pylist() for w in words_of(t) if (h := xxhash.xxh64_intdigest(w) >> 1) in keys}
            yield pa.RecordBatch.from_arrays([pa.array(list(found.values()), pa.int64()), pa.array(list(found), pa.string())], ["h", "word"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """Fits on at most max_rows labelled documents (ids by lowest hash) of max_bytes; the driver holds their distinct words' hashes.

    Labels tell toxic or not. Severity grades are induced: words far more frequent in toxic documents are markers,
    and a toxic document's grade is 1 with up to one marker, 2 with two or three, 3 with more; others have grade 0. The
    markers that grade a document are found in the other half of the documents, never by its own label.
    The threshold maximises F1 on the fifth of the rows that was not trained on. None without labels of both kinds.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labelled = texts.join(F.broadcast(chosen), "doc_id")  # max_rows ids
    found = labelled.mapInArrow(_hashed, "doc_id long, toxic int, words binary, n long").withColumn("row", F.monotonically_increasing_id())
    found = written(found.withColumn("place", F.xxhash64("doc_id")), "toxicity_words")
    first = found.select("place", "doc_id", "row", "n").orderBy("place", "doc_id", "row").limit(max_rows).collect()  # an id may have several documents
    size = np.cumsum([8 * r["n"] for r in first])
    last = int(np.searchsorted(size, max_bytes, side="right")) - 1
    if last < 0:
        return None
    end = first[last]
    within = F.struct("place", "doc_id", "row") <= F.struct(*[F.lit(end[c]).cast("long") for c in ("place", "doc_id", "row")])
    rows = sorted((r["doc_id"], r["toxic"], bytes(r["words"])) for r in found.where(within).collect())
    y = np.array([r[1] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    features = [np.frombuffer(r[2], np.int64) for r in rows]
    held = np.fromiter((xxhash.xxh64_intdigest(str(r[0])) % HELD_OUT == 0 for r in rows), bool, len(rows))
    if y[~held].min() == y[~held].max():
        held[:] = False
    vocabulary, flat = np.unique(np.concatenate(features), return_inverse=True)
    row = np.repeat(np.arange(len(y)), [len(f) for f in features])
    fit = ~held[row]
    df = np.bincount(flat[fit], minlength=len(vocabulary))
    pos = np.bincount(flat[fit], y[row[fit]], len(vocabulary))
    n, n_pos = (~held).sum(), y[~held].sum()
    share = n_pos / n
    z = (pos - df * share) / np.sqrt(np.maximum(df * share * (1 - share), 1e-9))
    used = np.flatnonzero((df >= 3) & (np.abs(z) >= 3))
    used = used[np.argsort(-np.abs(z[used]), kind="stable")][:MAX_FEATURES]
    if not len(used):
        return None
    place = np.full(len(vocabulary), -1)
    place[used] = np.arange(len(used))
    keep = place[flat] >= 0
    half = np.fromiter((xxhash.xxh64_intdigest(f"half {r[0]}") % 2 for r in rows), np.int64, len(rows))
    count = np.zeros(len(y), np.int64)
    for side in (0, 1):  # markers of one side grade the other
        other = fit & (half[row] != side)
        seen, bad = np.bincount(flat[other], minlength=len(vocabulary)), np.bincount(flat[other], y[row[other]], len(vocabulary))
        k, k_bad = (~held & (half != side)).sum(), y[~held & (half != side)].sum()
        markers = (bad >= 2) & ((bad + 0.1) / max(k_bad, 1) >= 10 * (seen - bad + 0.5) / max(k - k_bad, 1))
        count += np.bincount(row, markers[flat] & (half[row] == side), len(y)).astype(np.int64)
    grade = np.where(y == 0, 0, np.select([count <= 1, count <= 3], [1, 2], 3))
    split = np.split(place[flat][keep], np.cumsum(np.bincount(row[keep], minlength=len(y)))[:-1])
    train_rows = np.flatnonzero(~held)
    w, cuts = fit_ordinal(Sparse([split[i] for i in train_rows], len(used)), grade[train_rows])
    p = _sigmoid(Sparse(split, len(used)).dot(w) - cuts[0])
    judged = held if held.any() and y[held].max() == 1 else ~held
    threshold, held_out = _best_threshold(p[judged], y[judged])
    hashes = vocabulary[used]
    live = {int(h): float(x) for h, x in zip(hashes, w, strict=True) if abs(x) > 1e-6}
    wanted = spark.sparkContext.broadcast(live)
    spelled = labelled.select("text").mapInArrow(_spelled(wanted), "h long, word string").distinct().collect()  # words of the sample that have weights
    return OrdinalModel({r["word"]: live[r["h"]] for r in spelled}, cuts.tolist(), threshold, held_out)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, float]]:
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    called = np.arange(1, len(y) + 1)
    f1 = 2 * hits / (called + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal scores are called together
    best = int(np.argmax(np.where(last, f1, -1)))
    nxt = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + nxt) / 2), {"f1": float(f1[best]), "precision": float(hits[best] / called[best]), "recall": float(hits[best] / max(1, y.sum())), "rows": float(len(y))}


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, p_toxic (grade 1 or more), severity (expected grade, 0 to 3), toxic.

    Trained on a bounded sample of the labelled rows, applied to every whole text. Null and empty texts have no
    words and get the base rate's severity. Without labels of both kinds nothing is called toxic (probability and
    severity 0). Labels with null id or label are skipped; of several labels for an id the highest counts. Rows that repeat ids
    and null ids are answered row by row; empty tables give empty results; other columns are not read.
    """
    model = train(docs, labels, max_rows, id_col=id_col, text_col=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            p, severity = own.expected(texts) if own else (np.zeros(len(texts)), np.zeros(len(texts)))
            toxic = p >= own.threshold if own else np.zeros(len(texts), bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(severity), pa.array(toxic)], ["doc_id", "p_toxic", "severity", "toxic"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, p_toxic double, severity double, toxic boolean")
