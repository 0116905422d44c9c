"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (lower-cased runs of letters, digits and non-ASCII bytes) form overlapping windows of SPAN words. A word's input is its own
embedding and those of its first PREFIXES bytes, where they are in their vocabularies, and the mean of the embeddings of its character trigrams. Two recurrent layers read
a window in either direction, attention weighs their states, and a linear layer gives the window's logit; a text's
score comes from its highest window. Training takes, in each epoch, the highest of a few windows of each text.

The vocabularies hold what several labelled texts have; the first cell of an embedding starts at its evidence for the label in the texts it
is learned from. Labels come from rows that are not held out, at most MOST_EACH of each label, those of least hash of
doc_id, and of those texts the first that hold MOST_BYTES together; a doc_id that is labelled both ways teaches nothing, and of rows
that share one the least text is learned from. Every whole text is scored. Defined results: a null or empty text has no window, and its score is that of the
output's bias; repeated rows have equal scores; without labels of both kinds every score is zero; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, documents, mix, texts_of, word_keys
from tessera.llm.quality_model import held_out

SPAN, STRIDE = 64, 32
PREFIXES = (4, 6)
WORD_CELLS, CHAR_CELLS, HIDDEN = 4, 4, 8
TRIGRAMS = 2048
LEAST_TEXTS, MOST_WORDS = 3, 50_000
MOST_EACH = 1000
#: Bytes of labelled texts that are learned from.
MOST_BYTES = 64 << 20
EPOCHS, BATCH, RATE, DECAY = 10, 128, 0.01, 1e-4
#: Windows of a text that training chooses among.
CHOICE = 4

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c


class Words:
    """The words of some texts: each text's words as indices into distinct ones, with the bytes of those."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.data = _FOLD[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        solid = np.concatenate([[False], self.data != 32])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        start, end = edges[::2], edges[1::2]
        hashes = word_keys(self.data, start, end)
        self.keys, at, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        self.start, self.end = start[at], end[at]
        self.begins = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in raw)]))

    def keys_of(self, prefix: int) -> np.ndarray:
        """A hash of the first bytes of each distinct word, 0 where it is shorter; the whole word's for prefix 0."""
        if not prefix:
            return self.keys
        long_enough = self.end - self.start >= prefix
        hashes = word_keys(self.data, self.start, np.minimum(self.start + prefix, self.end))
        return np.where(long_enough, mix(hashes, prefix), np.uint64(0))

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the character trigrams of all distinct words, marked at both ends, and where each word's begin."""
        size = self.end - self.start
        n = size  # a word of n bytes has n trigrams once a mark is put at either end
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start, n)
        inside = np.repeat(self.start, n), np.repeat(self.end, n)
        left = np.where(at > inside[0], self.data[np.maximum(at - 1, 0)], 32).astype(np.uint64)
        right = np.where(at + 1 < inside[1], self.data[np.minimum(at + 1, len(self.data) - 1)], 32).astype(np.uint64)
        cells = mix(left << np.uint64(16) | self.data[at].astype(np.uint64) << np.uint64(8) | right) % np.uint64(TRIGRAMS)
        return cells.astype(np.int64), np.cumsum(n) - n

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and text of every window; each text with words has at least one."""
        n = np.diff(self.begins)
        count = np.where(n > 0, np.maximum(-(-(n - SPAN) // STRIDE), 0) + 1, 0)
        text = np.repeat(np.arange(len(n)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin = nth * STRIDE
        return self.begins[:-1][text] + begin, np.minimum(SPAN, n[text] - begin), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters by name, the vocabularies (sorted hashes, evidence) by prefix, and the passes forward and back."""

    def __init__(self, vocabularies: dict[int, tuple[np.ndarray, np.ndarray]], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.keys = {n: keys for n, (keys, _) in vocabularies.items()}
        cells, h = WORD_CELLS * len(vocabularies) + CHAR_CELLS, HIDDEN
        p = {"char": rng.normal(0, 0.1, (TRIGRAMS, CHAR_CELLS))}
        for n, (keys, evidence) in vocabularies.items():
            p[f"word{n}"] = rng.normal(0, 0.05, (len(keys) + 1, WORD_CELLS))
            p[f"word{n}"][0] = 0
            p[f"word{n}"][1:, 0] = evidence
        for way in "fb":
            p[f"x{way}"] = rng.normal(0, cells**-0.5, (cells, 3 * h))
            p[f"h{way}"] = rng.normal(0, h**-0.5, (h, 3 * h))
            p[f"b{way}"] = np.zeros(3 * h)
        p |= {"a": rng.normal(0, (2 * h) ** -0.5, (2 * h, h)), "v": rng.normal(0, 1.0, h), "o": rng.normal(0, (2 * h) ** -0.5, 2 * h), "c": np.full(1, -1.0)}
        self.p = {k: x.astype(np.float32) for k, x in p.items()}

    def looked_up(self, words: Words) -> tuple[np.ndarray, tuple]:
        """The input of each distinct word, and what the way back needs."""
        rows, parts = [], []
        for n, keys in self.keys.items():
            rows.append(_rows(keys, words.keys_of(n)))
            parts.append(self.p[f"word{n}"][rows[-1]])
        cells, begin = words.trigrams()
        size = (words.end - words.start).astype(np.float32)
        mean = np.add.reduceat(self.p["char"][cells], begin, axis=0) / size[:, None] if len(cells) else np.zeros((0, CHAR_CELLS), np.float32)
        return np.concatenate([*parts, mean], axis=1), (rows, cells, begin, size)

    def _read(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction over x (time, windows, 3 * HIDDEN)."""
        h, u = HIDDEN, self.p[f"h{way}"]
        state = np.zeros((x.shape[1], h), np.float32)
        states, saved = np.zeros((len(x), x.shape[1], h), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g = state @ u
            zr = _sigmoid(x[t, :, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * g[:, 2 * h :])
            new = n + z * (state - n)
            if keep:
                saved.append((t, state, z, r, n, g[:, 2 * h :]))
            state = np.where(mask[t][:, None], new, state)
            states[t] = state
        return states, saved

    def logits(self, inputs: np.ndarray, index: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logit of each window of words index[start : start + length]; with keep, what the way back needs too."""
        most = int(length.max()) if len(length) else 0
        at = np.minimum(start[None] + np.arange(most)[:, None], len(index) - 1)
        mask = np.arange(most)[:, None] < length[None]
        word = index[at]
        seen = {w: inputs @ self.p[f"x{w}"] + self.p[f"b{w}"] for w in "fb"}
        both, saved = zip(*(self._read(w, seen[w][word], mask, keep) for w in "fb"))
        states = np.concatenate(both, axis=2)
        lit = np.tanh(states @ self.p["a"])
        e = np.where(mask, lit @ self.p["v"], -1e9)
        weight = np.exp(e - e.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        out = pooled @ self.p["o"] + self.p["c"][0]
        return (out, (word, mask, states, lit, weight, pooled, saved)) if keep else out

    def slopes(self, inputs: np.ndarray, found: tuple, kept: tuple, by_out: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives of the loss by every parameter, given those by each window's logit."""
        word, mask, states, lit, weight, pooled, saved = kept
        rows, cells, begin, size = found
        p, h = self.p, HIDDEN
        d = {"o": pooled.T @ by_out, "c": np.array([by_out.sum()], np.float32)}
        by_pooled = np.outer(by_out, p["o"])
        by_states = weight[:, :, None] * by_pooled
        by_weight = (states * by_pooled).sum(axis=2)
        by_e = weight * (by_weight - (weight * by_weight).sum(axis=0))
        d["v"] = np.einsum("tw,twk->k", by_e, lit)
        by_lit = by_e[:, :, None] * p["v"] * (1 - lit**2)
        d["a"] = np.einsum("twi,twk->ik", states, by_lit)
        by_states = by_states + by_lit @ p["a"].T
        by_inputs = np.zeros_like(inputs)
        for k, way in enumerate("fb"):
            u = p[f"h{way}"]
            carry = np.zeros((word.shape[1], h), np.float32)
            by_u, by_x = np.zeros_like(u), np.zeros((len(word), word.shape[1], 3 * h), np.float32)
            for t, state, z, r, n, gn in reversed(saved[k]):
                total = carry + by_states[t, :, k * h : (k + 1) * h]
                here = np.where(mask[t][:, None], total, 0)
                by_n = here * (1 - z) * (1 - n**2)
                by_z = here * (state - n) * z * (1 - z)
                by_r = by_n * gn * r * (1 - r)
                by_g = np.concatenate([by_z, by_r, by_n * r], axis=1)
                by_x[t] = np.concatenate([by_z, by_r, by_n], axis=1)
                by_u += state.T @ by_g
                carry = np.where(mask[t][:, None], here * z + by_g @ u.T, total)
            d[f"h{way}"] = by_u
            flat, where = by_x.reshape(-1, 3 * h), word.ravel()
            by_seen = np.zeros((len(inputs), 3 * h), np.float32)
            np.add.at(by_seen, where, flat)
            d[f"b{way}"] = flat.sum(axis=0)
            d[f"x{way}"] = inputs.T @ by_seen
            by_inputs += by_seen @ p[f"x{way}"].T
        for k, (n, row) in enumerate(zip(self.keys, rows)):
            d[f"word{n}"] = np.zeros_like(p[f"word{n}"])
            np.add.at(d[f"word{n}"], row, by_inputs[:, k * WORD_CELLS : (k + 1) * WORD_CELLS])
            d[f"word{n}"][0] = 0
        d["char"] = np.zeros_like(p["char"])
        times = np.diff(np.append(begin, len(cells)))
        np.add.at(d["char"], cells, np.repeat(by_inputs[:, WORD_CELLS * len(rows) :] / size[:, None], times, axis=0))
        return d

    def scores(self, texts: list[str], most: int = 1024) -> np.ndarray:
        """Per text, the probability of its highest window."""
        words = Words(texts)
        start, length, text = words.windows()
        inputs, _ = self.looked_up(words)
        out = np.full(len(texts), -np.inf, np.float32)
        for k in range(0, len(start), most):
            part = slice(k, k + most)
            np.maximum.at(out, text[part], self.logits(inputs, words.index, start[part], length[part]))
        return _sigmoid(np.where(np.isinf(out), self.p["c"][0], out).astype(np.float64))


def evidence_of(keys: np.ndarray, words: Words, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the keys of distinct words, those (sorted) that LEAST_TEXTS texts or more have, and their signed evidence: the root of
    the log-likelihood ratio against the base rate, scaled to a few units."""
    distinct, cell = np.unique(keys, return_inverse=True)
    text = np.repeat(np.arange(len(label)), np.diff(words.begins))
    pair = np.unique(cell[words.index].astype(np.int64) * len(label) + text)
    word, of = pair // len(label), pair % len(label)
    n, pos = np.bincount(word, minlength=len(distinct)), np.bincount(word, label[of], len(distinct))
    keep = np.flatnonzero((n >= LEAST_TEXTS) & (distinct != 0))
    keep = np.sort(keep[np.argsort(-n[keep], kind="stable")[:MOST_WORDS]])
    n, pos, rate = n[keep].astype(float), pos[keep], label.mean()
    log = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / b), 0)
    g = 2 * (log(pos, n * rate) + log(n - pos, n * (1 - rate)))
    sign = np.where(pos > n * rate, 1.0, -1.0)
    return distinct[keep], sign * np.clip(np.sqrt(np.maximum(g, 0)) / 4, 0, 3)


def _rows(vocabulary: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The row of each key in an embedding whose row 0 is for what the vocabulary lacks."""
    if not len(vocabulary):
        return np.zeros(len(keys), np.int64)
    spot = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    return np.where(vocabulary[spot] == keys, spot + 1, 0)


def train(texts: list[str], label: np.ndarray, seed: int = 5) -> Network:
    """A network fitted to the texts' labels (0 or 1) by Adam over the highest windows of each text."""
    label = label.astype(np.float32)
    words = Words(texts)
    vocabularies = {n: evidence_of(words.keys_of(n), words, label) for n in (0, *PREFIXES)}
    net = Network(vocabularies, seed)
    start, length, text = words.windows()
    # Windows to choose among: those of highest evidence.
    most = np.max([np.append(0, e)[_rows(k, words.keys_of(n))] for n, (k, e) in vocabularies.items()], axis=0)
    strength = np.where(most > 0, np.exp(2 * most) - 1, 0)[words.index]
    total = np.concatenate([[0], np.cumsum(strength)])
    by = total[start + length] - total[start]
    order = np.lexsort((-by, text))
    first = np.searchsorted(text[order], np.arange(len(texts)))
    nth = np.arange(len(order)) - first[text[order]]
    chosen = np.sort(order[nth < CHOICE])
    start, length, text = start[chosen], length[chosen], text[chosen]
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6)) ** 0.5
    step = 0
    for _ in range(EPOCHS):
        inputs, _found = net.looked_up(words)
        out = np.concatenate([net.logits(inputs, words.index, start[k : k + 1024], length[k : k + 1024]) for k in range(0, len(start), 1024)])
        best = np.lexsort((-out, text))
        best = best[np.flatnonzero(np.concatenate([[True], text[best][1:] != text[best][:-1]]))]
        rng.shuffle(best)
        for k in range(0, len(best), BATCH):
            part = best[k : k + BATCH]
            # Only the words of these windows take part in the step.
            spans = np.concatenate([np.arange(a, a + n) for a, n in zip(start[part], length[part])])
            used, local = np.unique(words.index[spans], return_inverse=True)
            few = Words.__new__(Words)
            few.data, few.keys, few.start, few.end, few.index = words.data, words.keys[used], words.start[used], words.end[used], local
            inputs, found = net.looked_up(few)
            begin = np.cumsum(length[part]) - length[part]
            out, kept = net.logits(inputs, local, begin, length[part], keep=True)
            y = label[text[part]]
            by_out = (weight[text[part]] * (_sigmoid(out) - y) / len(part)).astype(np.float32)
            step += 1
            for name, g in net.slopes(inputs, found, kept, by_out).items():
                first_moment, second_moment = moments[name]
                first_moment += 0.1 * (g - first_moment)
                second_moment += 0.001 * (g * g - second_moment)
                move = first_moment / (1 - 0.9**step) / (np.sqrt(second_moment / (1 - 0.999**step)) + 1e-8)
                net.p[name] -= np.float32(RATE) * (move + np.float32(DECAY) * net.p[name]).astype(np.float32)
    return net


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(5, 0)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    sample = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_EACH) for y in (0, 1)]
    chosen = docs.select("doc_id", "text").join(sample[0].union(sample[1]), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    one = chosen.where(F.octet_length("text") <= MOST_BYTES).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over 2 * MOST_EACH rows
    learn = one.withColumn("so_far", so_far).where(F.col("so_far") <= MOST_BYTES).drop("so_far").collect()
    learn.sort(key=lambda r: (r.doc_id, r.toxic, r.text))
    label = np.array([r.toxic for r in learn], np.float64)
    net = train([r.text for r in learn], label) if len(set(label.tolist())) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1 << 20):
            score = net.scores(texts_of(batch)) if net else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(5, 0).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
