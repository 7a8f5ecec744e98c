"""Quality classifier by positive-unlabelled learning.

Features are language-free: every byte falls into one of nine classes (lower case,
upper case, digit, space, new line, sentence mark, symbol, other mark, beyond
ASCII), and a text is described by the square roots of its class trigram shares,
plus eight shape measures: shares of capitals and letters, lengths of words, lines
and the text, and three measures of repetition, as rules for web text use them
(equal lines, words equal to the one before, words met before). A linear scorer
with logistic loss minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

over trusted positives and unlabelled web text; when a batch's second term falls
below zero its gradient is turned round, which keeps the flexible part of the risk
from over-fitting. Labelled negatives are used nowhere.

The class prior is estimated from positives and unlabelled text alone, by the best
bin of a cross-fitted scorer: above a threshold lie a share ``q_u`` of the unlabelled and
``q_p`` of the positives, ``q_u / q_p`` is never below the prior but for chance, and
the threshold is the one whose ratio has the least upper confidence bound. One standard
error comes off: the ratio errs upwards, and too high a prior pulls unlabelled
negatives up.

Learning uses a bounded sample (``LEARN_POSITIVES`` positives and
``LEARN_UNLABELLED`` rows, by rank of a hash of id and text) in one task. Ids and hashes
are cut by a count of the rows before they are ranked, and only the texts chosen
move. Scoring covers every whole text and has no state.

Defined results: null and empty texts get the score of the zero vector, which the
bias alone decides; labels without a value or an id are not learnt from; rows that
repeat (id and text) are learnt from once, and of several texts under one labelled
id the one of least hash; without a positive or any text every score is 0.5; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key
from .shingles import word_hashes

LEARN_POSITIVES = 3000
LEARN_UNLABELLED = 6000
THRESHOLD = 0.3
EPOCHS = 60
#: Small samples get more epochs, up to so many steps.
STEPS = 600
BATCH = 512
CLASSES = 9
GRAMS = CLASSES**3
SHAPES = 8
DIMENSIONS = GRAMS + SHAPES + 1

_CLASS = np.full(256, 7, dtype=np.int64)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?!'\"-()"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 6
_CLASS[128:] = 8
PIECE = 1 << 20


def vector(text: str | None) -> np.ndarray:
    """Features of a whole text, gathered in pieces."""
    out = np.zeros(DIMENSIONS, dtype=np.float64)
    out[-1] = 1.0
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) if text else np.empty(0, np.uint8)
    if not len(data):
        return out
    grams, singles = np.zeros(GRAMS), np.zeros(CLASSES)
    n_words, repeats, distinct = 0, 0, [np.empty(0, dtype=np.uint64)]
    for at in range(0, len(data), PIECE):
        c = _CLASS[data[max(at - 2, 0) : at + PIECE]]
        singles += np.bincount(c[min(at, 2) :], minlength=CLASSES)
        if len(c) > 2:
            grams += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=GRAMS)
        h, _ = word_hashes([data[at : at + PIECE].tobytes()])
        n_words += len(h)
        repeats += int((h[1:] == h[:-1]).sum())
        distinct = [np.unique(np.concatenate([*distinct, h]))]
    again = repeats / max(n_words, 1)
    out[:GRAMS] = np.sqrt(grams / max(grams.sum(), 1.0))
    letters = singles[0] + singles[1] + singles[8]
    lines = text.split("\n")
    words = max(singles[3] + singles[4] + 1, 1.0)
    out[GRAMS : GRAMS + SHAPES] = (
        singles[1] / max(letters, 1.0),
        letters / len(data),
        min(len(data) / words / 10.0, 2.0),
        1.0 - len(set(lines)) / len(lines),
        min(np.log1p(len(data)) / 12.0, 2.0),
        min(np.log1p(len(data) / len(lines)) / 8.0, 2.0),
        again,
        1.0 - len(distinct[0]) / max(n_words, 1),
    )
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def risk_parts(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """``prior * R_p(+)`` and ``R_u(-) - prior * R_p(-)`` under logistic loss."""
    sp, su = sigmoid(p @ w), sigmoid(u @ w)
    return -prior * np.log(sp + 1e-12).mean(), -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()


def step_direction(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the risk; where its second part is negative, that part's gradient turned round."""
    sp, su = sigmoid(p @ w), sigmoid(u @ w)
    as_positive = p.T @ (sp - 1) / len(p)
    as_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    return prior * as_positive + as_negative if risk_parts(w, p, u, prior)[1] >= 0 else -as_negative


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> np.ndarray:
    """Weights that minimise the non-negative risk, by Adam over paired batches."""
    rng = np.random.default_rng(seed)
    w, m, v, step = np.zeros(positive.shape[1]), 0.0, 0.0, 0
    rounds = max(1, -(-len(unlabelled) // BATCH))
    epochs = max(epochs, -(-STEPS // rounds))
    for epoch in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for p_part, u_part in zip(np.array_split(p_order, rounds), np.array_split(u_order, rounds), strict=True):
            if not len(p_part) or not len(u_part):
                continue
            g = step_direction(w, positive[p_part], unlabelled[u_part], prior) + decay * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def best_bin(of_positives: np.ndarray, of_unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled, from scores that were not fitted on them."""
    at = np.unique(of_positives)
    q_p = 1 - np.searchsorted(np.sort(of_positives), at) / len(of_positives)
    q_u = 1 - np.searchsorted(np.sort(of_unlabelled), at) / len(of_unlabelled)
    chance = sum((np.log(4 / delta) / (2 * len(x))) ** 0.5 for x in (of_positives, of_unlabelled))
    k = ((q_u + (1 + gamma) * chance) / q_p).argmin()
    share, a, b = q_u[k] / q_p[k], q_u[k], q_p[k]
    error = (a * (1 - a) / len(of_unlabelled) + share**2 * b * (1 - b) / len(of_positives)) ** 0.5 / b
    return float(share - error)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled text, each half scored by the other's fit."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    found = []
    for k in (0, 1):
        w = fit(positive[k::2], unlabelled[k::2], 0.5, epochs=10)
        found.append(best_bin(positive[1 - k :: 2] @ w, unlabelled[1 - k :: 2] @ w))
    return float(np.clip(np.mean(found), 0.05, 0.95))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learning_sample(docs: DataFrame, usable: DataFrame, doc_id: str, text: str, positives: int, unlabelled: int) -> DataFrame:
    """``y, _text``: at most ``positives`` texts of the positive rows of ``usable`` (``_l,
    _y``) and ``unlabelled`` of all rows."""
    d = docs.select(*row_key(doc_id, text), F.col(text).alias("_text"))
    chosen = usable.where("_y = 1").select("_l", F.xxhash64("_l").alias("_r")).distinct().orderBy("_r", "_l").limit(positives)
    trusted = d.join(F.broadcast(chosen), F.col("_id") == F.col("_l"), "left_semi").groupBy("_id").agg(F.min(F.struct("_h", "_text"))["_text"].alias("_text"))
    n = docs.count()
    rank = F.xxhash64("_id", "_h", F.lit("web"))
    low = (F.shiftrightunsigned(rank, 11) / float(1 << 53)) * n < 1.3 * unlabelled + 50
    wanted = d.where(low).select(F.col("_id").alias("_wi"), F.col("_h").alias("_wh"), rank.alias("_r")).distinct().orderBy("_r", "_wi", "_wh").limit(unlabelled)
    web = d.join(F.broadcast(wanted), (F.col("_id") == F.col("_wi")) & (F.col("_h") == F.col("_wh")), "left_semi").groupBy("_id", "_h").agg(F.first("_text").alias("_text"))
    return trusted.select(F.lit(1).alias("y"), "_text").union(web.select(F.lit(0).alias("y"), "_text"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fold: Column | None = None, positives: int = LEARN_POSITIVES, unlabelled: int = LEARN_UNLABELLED) -> tuple[np.ndarray, float] | None:
    """Weights and class prior; None without a positive. ``fold`` says which label
    rows may be learnt from, in terms of the labels' id column."""
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    if fold is not None:
        usable = usable.where(fold)
    usable = usable.select(F.col(doc_id).cast("long").alias("_l"), F.col(label).cast("int").alias("_y"))
    sample = learning_sample(docs, usable, doc_id, text, positives, unlabelled)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [vector(t.as_py()).astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["y", "x"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(b, dtype=np.float32) for b in group["x"]]).astype(np.float64)
        y = group["y"].to_numpy()
        if not (y == 1).any() or not (y == 0).any():
            return pd.DataFrame({"w": [], "prior": []})
        by = np.lexsort((group["x"].to_numpy(), y))  # whatever order the rows arrive in
        x, y = x[by], y[by]
        prior = estimate_prior(x[y == 1], x[y == 0])
        return pd.DataFrame({"w": [fit(x[y == 1], x[y == 0], prior).tobytes()], "prior": [prior]})

    row = sample.mapInArrow(vectors, "y int, x binary").groupBy(F.lit(1).alias("_all")).applyInPandas(learn, "w binary, prior double").collect()
    return (np.frombuffer(bytes(row[0]["w"])), row[0]["prior"]) if row else None


def score(docs: DataFrame, trained: tuple[np.ndarray, float] | None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each row."""
    weights = None if trained is None else trained[0]
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                if weights is None:
                    s = np.full(part.num_rows, 0.5)
                else:
                    s = sigmoid(np.stack([vector(t.as_py()) for t in part.column(1)]) @ weights)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(apply, "doc_id long, score double, predicted int")
