"""Language identification by interpolated Kneser-Ney character models.

One model per language: character n-grams up to ``ORDER`` with interpolated
Kneser-Ney smoothing, the longest order on counts, shorter ones on continuation
counts. N-grams and contexts are 64-bit hashes in sorted arrays, searched by binary
search; a text's cross-entropy under each model is divided by its length and the
lowest wins. Letters are lower-cased and every run of other characters is one space.

Calibration. A fifth of the learning sample stays out of the counts. From it come
the temperature that turns cross-entropies into the score of the winner, and each
language's rejection limit: a text whose cross-entropy exceeds what
``ACCEPT`` of the language's own texts show is ``rejected``.

Learning uses a bounded sample: at most ``LEARN_DOCS`` whole texts and
``LEARN_CHARS`` characters per language, taken by rank of a hash of the id; a text that
does not fit the characters left is passed over, not the end of the sample (where none
fits alone, the first is cut). The calibration texts are bounded in the same way by
``CALIBRATE_CHARS``. One language's sample is one task; nothing else depends on a sample. Prediction covers
every whole text, in pieces of bounded size.

Defined results: null text, or text without a letter: ``und``, score 0, rejected.
Rows without a language or an id outside the learning folds are not learnt from; with nothing
to learn every text is ``und``.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize
from .shingles import mix

ORDER = 5
LEARN_DOCS = 1500
LEARN_CHARS = 3_000_000
CALIBRATE_CHARS = 300_000
ACCEPT = 0.995
UNKNOWN = "und"
#: Characters scored at once, and scored n-grams remembered by a worker.
PIECE = 1 << 20
REMEMBER = 1 << 21

_START = "\x01"
_STEP = np.uint64(0x9FB21C651E98DF25)
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0 to order, hashes of the k characters that end at each place."""
    found = [np.zeros(len(codes), dtype=np.uint64)]
    with np.errstate(over="ignore"):
        raw = np.zeros(len(codes), dtype=np.uint64)
        power = np.uint64(1)
        for k in range(1, order + 1):
            shifted = np.zeros_like(codes)
            shifted[k - 1 :] = codes[: len(codes) - k + 1]
            raw = raw + (shifted + np.uint64(1)) * power
            power = power * _STEP
            found.append(mix(raw + np.uint64(k)))
    return found


class Model:
    """Sorted hash arrays of one language: for each order the n-grams with their
    counts, and the contexts with total and number of followers."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.order = int(arrays["order"])

    @classmethod
    def learn(cls, texts: list[str], order: int = ORDER) -> Model:
        codes, places = encode([(_START * (order - 1), t) for t in texts if t], order)
        arrays: dict[str, np.ndarray] = {"order": np.int64(order)}
        hashes = [h[places] for h in gram_hashes(codes, order)]
        ends = [h[places - 1] for h in gram_hashes(codes, order - 1)]
        kept = np.arange(len(places))
        for k in range(order, 0, -1):
            grams, first, counts = np.unique(hashes[k][kept], return_index=True, return_counts=True)
            at = kept[first]  # where each distinct n-gram stands
            contexts, which = np.unique(ends[k - 1][at], return_inverse=True)
            arrays[f"gram{k}"], arrays[f"count{k}"] = grams, counts.astype(np.float32)
            arrays[f"context{k}"] = contexts
            arrays[f"total{k}"] = np.bincount(which, counts, len(contexts)).astype(np.float32)
            arrays[f"follow{k}"] = np.bincount(which, minlength=len(contexts)).astype(np.float32)
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            arrays[f"discount{k}"] = np.float64(once / (once + 2 * twice) if once else 0.5)
            kept = at  # shorter orders count distinct predecessors
        arrays["uniform"] = np.float64(1.0 / (len(arrays["gram1"]) + 1))
        return cls(arrays)

    def log_prob(self, hashes: list[np.ndarray], ends: list[np.ndarray]) -> np.ndarray:
        """Log probability of each n-gram's last character after the others."""
        a, p = self.arrays, np.full(len(hashes[0]), float(self.arrays["uniform"]))
        for k in range(1, self.order + 1):
            at, seen = find(a[f"context{k}"], ends[k - 1])
            total = np.where(seen, a[f"total{k}"][at], 1.0)
            spread = np.where(seen, a[f"follow{k}"][at], 0.0)
            at, known = find(a[f"gram{k}"], hashes[k])
            count = np.where(known & seen, a[f"count{k}"][at], 0.0)
            d = float(a[f"discount{k}"])
            p = np.where(seen, np.maximum(count - d, 0.0) / total + d * spread / total * p, p)
        return np.log(p)


def find(among: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(among, wanted), max(len(among) - 1, 0))
    return at, among[at] == wanted


def encode(pieces: list[tuple[str, str]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all pieces (context, body) in turn, and the body's places."""
    joined = "".join(c + b for c, b in pieces)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    body = np.ones(len(codes), dtype=bool)
    at = 0
    for c, b in pieces:
        body[at : at + order - 1] = False
        at += len(c) + len(b)
    return codes, np.flatnonzero(body)


class Scorer:
    """Cross-entropies of texts under all models."""

    def __init__(self, models: dict[str, Model]):
        self.names = sorted(models)
        self.models = [models[x] for x in self.names]
        self.order = self.models[0].order
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, dtype=np.uint64)
        self.logs = np.empty((0, len(self.models)))

    def table(self, grams: np.ndarray, hashes: list[np.ndarray], ends: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of distinct n-grams; those met before are remembered."""
        at, seen = find(self.known, grams) if len(self.known) else (np.zeros(len(grams), int), np.zeros(len(grams), bool))
        logs = np.empty((len(grams), len(self.models)))
        logs[seen] = self.logs[at[seen]]
        new = ~seen
        if new.any():
            part = [h[new] for h in hashes], [e[new] for e in ends]
            logs[new] = np.column_stack([m.log_prob(*part) for m in self.models])
            if len(self.known) > REMEMBER:
                self.forget()
            grown = np.concatenate([self.known, grams[new]])
            by = np.argsort(grown, kind="stable")
            self.known, self.logs = grown[by], np.concatenate([self.logs, logs[new]])[by]
        return logs

    def sums(self, pieces: list[tuple[str, str]]) -> np.ndarray:
        codes, places = encode(pieces, self.order)
        every = gram_hashes(codes, self.order)
        top = every[-1][places]
        which, grams = pd.factorize(top)
        first = np.empty(len(grams), dtype=np.int64)
        first[which[::-1]] = places[::-1]
        logs = self.table(grams, [h[first] for h in every], [h[first - 1] for h in every[:-1]])
        starts = np.cumsum([0] + [len(b) for _, b in pieces[:-1]])
        return np.column_stack([np.add.reduceat(logs[which, k], starts) for k in range(len(self.models))])

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Rows of length-normalised cross-entropies; infinite for empty texts."""
        out = np.zeros((len(texts), len(self.models)))
        held: list[tuple[str, str]] = []
        owner: list[int] = []
        size, reach = 0, self.order - 1

        def flush() -> None:
            nonlocal size
            if held:
                np.subtract.at(out, owner, self.sums(held))
            held.clear()
            owner.clear()
            size = 0

        for i, t in enumerate(texts):
            for at in range(0, len(t), PIECE):
                body = t[at : at + PIECE]
                held.append((t[at - reach : at] if at else _START * reach, body))
                owner.append(i)
                size += len(body)
                if size >= PIECE:
                    flush()
        flush()
        lengths = np.array([len(t) for t in texts], dtype=float)[:, None]
        return np.where(lengths > 0, out / np.maximum(lengths, 1), np.inf)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def learning_sample(docs: DataFrame, doc_id: str, text: str, lang: str, fold: Column, n_docs: int, n_chars: int) -> DataFrame:
    """``lang, rank, text`` of the bounded sample. The share of each language is
    cut by its count before any text moves."""
    usable = docs.where(F.col(lang).isNotNull() & fold & (F.length(text) > 0))
    counts = materialize(usable.groupBy(F.col(lang).cast("string").alias("_cl")).agg(F.count("*").alias("_c")), "languages")
    counts = broadcast_if_small(counts, counts.count(), 64)  # a row per language: the cut comes before any shuffle of text
    u = usable.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_r"), F.col(text).alias("text"))
    low = (F.shiftrightunsigned("_r", 11) / float(1 << 53)) * F.col("_c") < 1.3 * n_docs + 50
    u = u.join(counts, F.col("lang") == F.col("_cl")).where(low)
    order = Window.partitionBy("lang").orderBy("_r", "text")
    u = u.withColumns({"rank": F.row_number().over(order)}).where(F.col("rank") <= n_docs)
    size = F.length("text").cast("long")
    before = F.collect_list(size).over(order.rowsBetween(Window.unboundedPreceding, -1))  # lengths only
    taken = F.aggregate(before, F.lit(0).cast("long"), lambda a, x: F.when(a + x <= n_chars, a + x).otherwise(a))
    u = u.withColumns({"_taken": taken, "_least": F.min(size).over(Window.partitionBy("lang"))})
    u = u.where((F.col("_taken") + size <= n_chars) | ((F.col("rank") == 1) & (F.col("_least") > n_chars)))
    return u.select("lang", "rank", F.substring("text", 1, n_chars).alias("text"))


def fitting(texts: list[str], n_chars: int) -> list[str]:
    """The texts that fit in turn; where none does, the first one cut."""
    found, left = [], n_chars
    for t in texts:
        if len(t) <= left:
            found.append(t)
            left -= len(t)
    return found or [t[:n_chars] for t in texts[:1]]


def _learn(group: pd.DataFrame, n_apart: int) -> pd.DataFrame:
    texts = [normal(t) for t in group["text"]]
    apart = group["rank"].to_numpy() % 5 == 0
    model = Model.learn([t for t, x in zip(texts, apart, strict=True) if not x and t] or [t for t in texts if t] or ["?"])
    kept = "\x00".join(fitting([t for t, x in zip(texts, apart, strict=True) if x and t], n_apart))
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "model": [pack(model.arrays)], "apart": [kept]})


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: Column | None = None, n_docs: int = LEARN_DOCS, n_chars: int = LEARN_CHARS, n_apart: int = CALIBRATE_CHARS) -> dict | None:
    """Models, temperature and rejection limits; None with nothing to learn. At most
    ``n_apart`` characters of a language calibrate. Models are bounded by the sample, so they may come to the driver."""
    sample = learning_sample(docs, doc_id, text, lang, F.lit(True) if fold is None else fold, n_docs, n_chars)
    rows = sample.groupBy("lang").applyInPandas(lambda group: _learn(group, n_apart), "lang string, model binary, apart string").collect()
    if not rows:
        return None
    packed = {r["lang"]: bytes(r["model"]) for r in rows}
    scorer = Scorer({k: Model(unpack(v)) for k, v in packed.items()})
    found, truth = [], []
    for r in rows:
        texts = [t for t in r["apart"].split("\x00") if t]
        if texts:
            found.append(scorer.entropies(texts))
            truth += [scorer.names.index(r["lang"])] * len(texts)
    limits, temperature = [float("inf")] * len(scorer.names), 8.0
    if found:
        h, y = np.concatenate(found), np.array(truth)
        losses = {t: -np.log(softmax(-h * t)[np.arange(len(y)), y] + 1e-12).mean() for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)}
        temperature = min(losses, key=losses.get)
        for k in range(len(limits)):
            if (y == k).sum() >= 20:
                limits[k] = float(np.quantile(h[y == k, k], ACCEPT))
    return {"models": packed, "limits": limits, "temperature": temperature}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, trained: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected, cross_entropy`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer = Scorer({k: Model(unpack(v)) for k, v in known["models"].items()}) if known else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = part.column(1).to_pylist()
                names, scores, rejected, entropy = [], [], [], []
                texts = [normal(t) for t in raw]
                h = scorer.entropies(texts) if scorer else None
                for i, t in enumerate(raw):
                    if scorer is None or not texts[i] or not has_letter(t):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        rejected.append(True)
                        entropy.append(None)
                        continue
                    k = int(h[i].argmin())
                    names.append(scorer.names[k])
                    scores.append(float(softmax(-h[i : i + 1] * known["temperature"])[0, k]))
                    rejected.append(bool(h[i, k] > known["limits"][k]))
                    entropy.append(float(h[i, k]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropy, pa.float64())], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(score, "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double")
