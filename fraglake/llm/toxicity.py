"""Toxicity scores from non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else is unlabelled, not
negative.  With the class prior pi (the share of toxic rows among the training
labels), the risk of calling a text clean is estimated from the unlabelled texts
less pi times that of the positives, and kept from going below zero (Kiryo et
al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator", 2017): where
the estimate is negative the step goes up that part instead, which stops the model
from memorising the positives.

The classifier is logistic regression over hashed features that a text has or
hasn't: each word, and its first 4, 5 and 6 bytes, so that stems count in
languages that inflect.  Words are runs of digits, a-z and non-ASCII characters
after lower-casing A-Z.  It is fitted with numpy on the driver, on a bounded
sample: ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled documents,
those with the smallest hashes of their ids, with ``MAX_FEATURES`` features each.  Every document is scored, over its
whole text.

Defined results: null and empty texts have no features and get the score of the
bias alone; without any positive to learn from every score is 0; rows with null
labels or ids aren't learned from, and labels that contradict each other for one
id make it a positive; repeated rows are scored alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text

FEATURE_BITS = 20
STEMS = (4, 5, 6)
#: Bounds of the training sample: texts of either kind, and distinct features of one text, those of the smallest numbers, which are hashes (256 MB in all).
MAX_POSITIVE = 2000
MAX_UNLABELLED = 6000
MAX_FEATURES = 8192
#: Features with less evidence are left out of the model.
LEAST_Z = 4.0
#: Weights nearer to zero than this are dropped after training.
LEAST_WEIGHT = 0.02


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a window of texts: feature numbers, and the text each belongs to; a feature may repeat."""
    data = _text.lower(data)
    starts, ends, first = _text.spans(_text.ALNUM[data], offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    spans = _text.SpanHash(data)
    shift = np.uint64(64 - FEATURE_BITS)
    hashed, owners = [spans(starts, ends)], [owner]
    for n in STEMS:
        long = ends - starts >= n
        hashed.append(spans(starts[long], starts[long] + n) * np.uint64(2 * n + 1))
        owners.append(owner[long])
    return (np.concatenate(hashed) >> shift).astype(np.int64), np.concatenate(owners)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Model:
    """Weights by feature number; a text's score is the logistic function of bias plus the sum over its features."""

    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, owner = features(data, offsets)
        counted = self.weights[found] != 0
        pairs = np.unique((owner[counted] << FEATURE_BITS) | found[counted])
        sums = np.bincount(pairs >> FEATURE_BITS, weights=self.weights[pairs & ((1 << FEATURE_BITS) - 1)], minlength=len(offsets) - 1)
        return _sigmoid(sums + self.bias)


NEVER = Model(np.zeros(1 << FEATURE_BITS, dtype=np.float32), -np.inf)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, epochs: int = 300, rate: float = 0.3, decay: float = 1e-4, sparsity: float = 2e-4) -> Model:
    """Full-batch nnPU with the logistic loss, in adaptive steps; each text is the array of its distinct features.

    ``sparsity`` shrinks weights to zero (an L1 penalty), so that common words,
    of which a long text has many, don't add up.
    """
    if not positive or not unlabelled or prior <= 0:
        return NEVER
    rows = [*positive, *unlabelled]
    n_pos, prior = len(positive), min(prior, 0.99)
    sizes = np.array([len(r) for r in rows])
    column, split = np.concatenate(rows), int(sizes[:n_pos].sum())
    # Only features whose share among the positives stands out from the unlabelled by LEAST_Z standard errors.
    n_unl = len(rows) - n_pos
    in_pos = np.bincount(column[:split], minlength=1 << FEATURE_BITS) / n_pos
    in_unl = np.bincount(column[split:], minlength=1 << FEATURE_BITS) / n_unl
    pooled = (in_pos * n_pos + in_unl * n_unl) / len(rows)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_unl))
    keep = np.abs(in_pos - in_unl) > LEAST_Z * np.maximum(error, 1e-9)
    used = np.flatnonzero(keep)
    mine = np.flatnonzero(keep[column])
    owner = np.searchsorted(np.cumsum(sizes), mine, side="right")
    column = np.searchsorted(used, column[mine])
    w, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, epochs + 1):
        margin = np.bincount(owner, weights=w[column], minlength=len(rows)) + bias
        p = _sigmoid(margin)
        # Losses log(1 + exp(-z)) as positive and log(1 + exp(z)) as negative; gradients p - 1 and p.
        negative = np.logaddexp(0, margin)
        rest = negative[n_pos:].mean() - prior * negative[:n_pos].mean()
        slope = np.zeros(len(rows))
        if rest >= 0:
            slope[:n_pos] = prior * (p[:n_pos] - 1) / n_pos - prior * p[:n_pos] / n_pos
            slope[n_pos:] = p[n_pos:] / (len(rows) - n_pos)
        else:
            slope[:n_pos] = prior * p[:n_pos] / n_pos
            slope[n_pos:] = -p[n_pos:] / (len(rows) - n_pos)
        g = np.bincount(column, weights=slope[owner], minlength=len(used)) + decay * w
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / np.sqrt(t)
        scale = step / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        w -= scale * (m / (1 - 0.9**t))
        w = np.sign(w) * np.maximum(np.abs(w) - scale * sparsity, 0)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
    weights[used] = np.where(np.abs(w) >= LEAST_WEIGHT, w, 0)
    return Model(weights, float(bias))


def _distinct_features(text: Column | str) -> Column:
    """The distinct features of a text; at most 2^20 numbers, however long it is."""

    @F.arrow_udf("array<int>")
    def of(column: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        for w in _text.windows(column):
            found, owner = features(w.data, w.offsets)
            pairs = np.unique((owner << FEATURE_BITS) | found)
            cuts = np.searchsorted(pairs >> FEATURE_BITS, np.arange(1, w.rows))
            out += np.split((pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32), cuts)
        return pa.array(out, type=pa.list_(pa.int32()))

    return of(text)


def held_out(key: Column | str) -> Column:
    """Whether the CRC-32 of an id, as text, is a multiple of 5; a null id counts as the text ``null``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, **options) -> Model:
    """Fit on labels and texts of ids that aren't held out.

    The prior comes from all training labels; the sample is bounded by
    ``max_positive`` and ``max_unlabelled`` texts of ``max_features`` features.
    """
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out("k"))
    share = known.agg(F.avg(F.when(F.col("y") == 1, 1.0).otherwise(0.0)).alias("prior")).first()["prior"] or 0.0
    positive = known.where("y = 1").select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(max_positive)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    # Unlabelled: a sample of all ids, whatever their labels, as the estimate of the risk asks for (one column is read for this).
    ids = docs.select(F.col(id_col).alias("k")).where(F.col("k").isNotNull() & ~held_out("k"))
    unlabelled = ids.distinct().orderBy(F.xxhash64("k", F.lit(1)), "k").limit(max_unlabelled)
    sample = positive.withColumn("y", F.lit(1)).union(unlabelled.withColumn("y", F.lit(0)))
    # At most max_positive + max_unlabelled ids are broadcast.
    # Of rows that share a sampled id, the one with the smallest text hash is taken.
    one = texts.join(F.broadcast(sample), "k").groupBy("y", "k").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = one.select("y", "k", F.slice(_distinct_features("t"), 1, max_features).alias("f")).toArrow().sort_by([("y", "ascending"), ("k", "ascending")])
    lists = rows.column("f").combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    parts = np.split(values[ends[0] : ends[-1]], ends[1:-1] - ends[0]) if len(lists) else []
    by: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for y, part in zip(rows.column("y").to_pylist(), parts, strict=True):
        by[y].append(part)
    return fit(by[1], by[0], share, **options)


def score(text: Column | str, model: Model) -> Column:
    """From 0 to 1; higher: toxic likelier."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        parts = [model.score(w.data, w.offsets) for w in _text.windows(column)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return of(text)


def scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score(text_col, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` without those that the model calls toxic."""
    return docs.where(score(F.col(text_col), model) < 0.5)
