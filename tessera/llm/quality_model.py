"""A quality classifier learned from positives and unlabelled text.

A small network is fitted by minimising the non-negative unbiased risk of positive-unlabelled learning:
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), with logistic losses. The class prior is estimated from the
data: over the thresholds of a first classifier of positives against unlabelled text, the least ratio of the shares
of unlabelled texts and of positives above it. Inputs are statistics of the whole text. Labels come from rows that are not
held out, and held-out rows are not used as unlabelled text either.

Fitting takes at most MOST_POSITIVE labelled positives and MOST_UNLABELLED unlabelled texts, those of least hash of doc_id; every
text is scored. Defined results: a doc_id that is labelled both ways is no positive; a null text is the empty text, which has a score like any other; repeated rows have equal scores;
without positives or without texts to learn from, every score is one half; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, documents, span_hashes, texts_of, window_hashes, word_hashes, word_spans, written

MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
HIDDEN, EPOCHS, RATE, DECAY = 16, 300, 0.02, 0.1
THRESHOLD = 0.7
#: Characters whose shares are statistics of their own.
GROUPS = (b"#*$%&|<>", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n", b"/@=_{}[]()")
N_FEATURES = 9 + len(GROUPS)


def features(texts: list[str]) -> np.ndarray:
    """One row of statistics per text, none of which depends on other texts."""
    raw = [t.encode() for t in texts]
    size = np.array([len(t) for t in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.cumsum([0, *(size + 1)])[:-1]
    start, end = word_spans(data)
    first = np.searchsorted(start, np.append(begins, len(data)))
    n_words = np.diff(first)
    of = np.repeat(np.arange(len(raw)), n_words)
    length = (end - start).astype(np.float64)
    per_text = lambda values, where: np.bincount(where, values, len(raw))
    total = per_text(length, of)
    many = np.maximum(n_words, 1)
    mean = total / many
    out = [np.log1p(n_words), mean, np.sqrt(np.maximum(per_text(length**2, of) / many - mean**2, 0)), np.log1p(size)]
    for group in GROUPS:
        table = np.zeros(256, bool)
        table[[*group]] = True
        hits = np.flatnonzero(table[data])
        count = per_text(None, np.searchsorted(begins, hits, side="right") - 1)
        if group == b"\n":
            count = count - 1  # the one that was put after each text
        out.append(np.log1p(1000 * count / np.maximum(size, 1)))
    words, bounds = word_hashes([t.lower() for t in raw])
    # The text above, 43 bits of the hash below: chunks hold fewer than 2**21 texts.
    distinct = lambda values, where: per_text(None, (np.unique(where.astype(np.uint64) << np.uint64(43) | values >> np.uint64(21)) >> np.uint64(43)).astype(np.int64))
    out.append(distinct(words, of) / many)
    three = window_hashes(words, 3)
    at = np.arange(len(three))
    inside = (of[at] == of[at + 2]) if len(three) else at.astype(bool)
    out.append(distinct(three[inside], of[at[inside]]) / np.maximum(n_words - 2, 1))
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
    keep = breaks > line_start
    lines, whose = span_hashes((data + np.uint8(0)).astype(np.uint64) + np.uint64(1), line_start[keep], breaks[keep]), np.searchsorted(begins, line_start[keep], side="right") - 1
    n_lines = np.maximum(np.bincount(whose, minlength=len(raw)), 1)
    out.append(distinct(lines, whose) / n_lines)
    out.append(np.log1p(n_words / n_lines))
    out.append((n_words == 0).astype(np.float64))
    return np.stack(out, axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """One hidden layer over standardised inputs, clipped to a few deviations."""

    center: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        hidden = np.tanh(z @ a + b)
        return hidden, hidden @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.inputs(x))[1])


def _fit(net: Network, slopes, x: np.ndarray, epochs: int, decay: float = DECAY) -> None:
    """Adam over all rows at once; slopes(outputs) gives the risk's derivative by each output."""
    z = net.inputs(x)
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for step in range(1, epochs + 1):
        hidden, out = net.forward(z)
        by_out = slopes(out)
        by_hidden = np.outer(by_out, net.weights[2]) * (1 - hidden**2)
        grads = [z.T @ by_hidden + decay * net.weights[0], by_hidden.sum(axis=0), hidden.T @ by_out + decay * net.weights[2], np.array([by_out.sum()])]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.weights[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def _start(unlabelled: np.ndarray, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    n = unlabelled.shape[1]
    weights = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    return Network(unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3, weights)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled texts, from scores of a classifier of the one against the other."""
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.quantile(p, np.linspace(0.0, 0.9, 91))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    slack = np.sqrt(np.log(20) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 11) -> tuple[Network, float]:
    """The network of least non-negative risk, and the class prior that was estimated."""
    n = len(positive)
    x = np.concatenate([positive, unlabelled]).astype(np.float64)
    first = _start(unlabelled.astype(np.float64), seed)
    sign = np.concatenate([np.full(n, 0.5 / n), np.full(len(unlabelled), -0.5 / len(unlabelled))])
    _fit(first, lambda out: -sign * _sigmoid(-np.sign(sign) * out), x, EPOCHS // 4)
    prior = class_prior(first.score(positive), first.score(unlabelled))
    net = _start(unlabelled.astype(np.float64), seed)

    def slopes(out: np.ndarray) -> np.ndarray:
        p, u = out[:n], out[n:]
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        by = np.zeros_like(out)
        if negative >= 0:
            by[:n] = (-prior * _sigmoid(-p) - prior * _sigmoid(p)) / n
            by[n:] = _sigmoid(u) / len(u)
        else:  # the part that fell below zero is undone
            by[:n] = prior * _sigmoid(p) / n
            by[n:] = -_sigmoid(u) / len(u)
        return by

    _fit(net, slopes, x, EPOCHS)
    return net, prior


def _featured(docs: DataFrame) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = features(texts_of(batch))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


def held_out(parts: int, which: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == which, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    rows = written(_featured(docs).withColumn("held_out", held_out(4, 2)))
    open_rows = rows.where("NOT held_out AND doc_id IS NOT NULL")
    told = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(4, 2)).groupBy("doc_id").agg(F.min("quality").alias("least"))
    trusted = told.where("least = 1").select("doc_id")
    take = lambda df, n: np.array([r.x for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("x").collect()], np.float32).reshape(-1, N_FEATURES)
    positive, unlabelled = take(open_rows.join(trusted, "doc_id", "left_semi"), MOST_POSITIVE), take(open_rows, MOST_UNLABELLED)
    net = train(positive, unlabelled)[0] if len(positive) and len(unlabelled) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)
            score = net.score(x) if net else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
