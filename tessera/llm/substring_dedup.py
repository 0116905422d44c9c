"""Removal of repeated passages, by windows whose length doubles level by level.

A window of WINDOW words goes if the same words also start earlier in the corpus. Level 1 takes five-word windows: of the five-word
windows inside a full window, the one with the least hash stands for it, so equal full windows have equal ones
and few positions are looked at. Those that occur once end here. Level 2 extends the survivors to twice the length (of the
ten-word windows around the five words and inside the full window, again the one with the least hash); those that occur once end
here. Level 3 is the full window: all but the earliest occurrence go.

What is equal is told by 128 bits: of a text, its BLAKE2b digest; of a word, two keyed hashes of its bytes; of a window, both hashes doubled up from
those of its halves, with a mixing step at each. The keys are drawn anew for each run, so that no text can be made to collide. A task
resolves what repeats among its own documents first: of the documents with the same words it lets only the first take part, and a window that
many of its documents have goes out under its own name about twice. Documents with the same words as an earlier one go whole.

Defined results: a null text has no words; rows with a null doc_id stay whole and remove nothing from others; rows that
share a doc_id are one document whose texts start at the same place; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import IS_SPACE, chunks, documents, mix, slices, texts_of, word_spans, written

BASE = 5
WINDOW = 4 * BASE
_SALT = 0x89ABCDEF
#: Words of more bytes are hashed one by one.
LONG = 64
#: Texts whose first occurrence a task remembers, and keys of windows; beyond them it sends more than it must.
MOST_TEXTS, KEYS = 1_000_000, 1 << 20
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _text_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers (128 bits) of the words of each text, and how many there are."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = IS_SPACE[data]
    stay = ~space
    stay[1:] |= stay[:-1] & space[1:]  # the one after a word
    at = np.concatenate([[0], np.cumsum(stay)])[np.cumsum([0, *(len(t) + 1 for t in texts)])]
    plain = np.where(space, np.uint8(32), data)[stay]
    blank = np.concatenate([[0], np.cumsum(plain == 32)])[at]
    digests = b"".join([hashlib.blake2b(plain[a:b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
    return np.frombuffer(digests, np.uint64).reshape(-1, 2), np.diff(blank)


def _word_hashes(texts: list[bytes], keys: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each key, a hash of every word of texts in order; and at which word each text begins (one more entry than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = word_spans(data)
    size = end - start
    wide = np.zeros(len(data) + 7, np.uint64)
    wide[: len(data)] = data
    for k in (1, 2, 4):  # two bytes at a place, four, eight
        wide[:-k] |= wide[k:] << np.uint64(8 * k)
    out = [size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key) for key in keys]
    which = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        which = which[size[which] > k] if k else which
        if not len(which):
            break
        block = wide[start[which] + k] & _KEEP[np.minimum(size[which] - k, 8)]
        for hashes in out:
            hashes[which] = mix(hashes[which] ^ block)
    for w in np.flatnonzero(size > LONG).tolist():
        for hashes, key in zip(out, keys):
            hashes[w] = int.from_bytes(hashlib.blake2b(data[start[w] : end[w]], digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return out, np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def _joined(left: np.ndarray, right: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of windows from those of their two parts, the second of which starts apart words later."""
    n = max(len(right) - apart, 0)
    return mix(mix(left[:n]) + right[apart : apart + n])


def _five(words: np.ndarray) -> np.ndarray:
    """Hashes of the windows of BASE words."""
    two = _joined(words, words, 1)
    return _joined(_joined(two, two, 2), words, 4)


def _zip(text: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(text.encode())


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


class _Firsts:
    """The least doc_id with which a task has seen each text."""

    def __init__(self):
        self.least: dict[bytes, int] = {}

    def later(self, digests: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of each document, whether one with the same words and a smaller doc_id was seen or is among these."""
        if len(self.least) > MOST_TEXTS:
            self.least.clear()
        out = np.zeros(len(doc), bool)
        for k in np.argsort(doc, kind="stable").tolist():
            key, own = digests[k].tobytes(), int(doc[k])
            first = self.least.get(key)
            if first is not None and first < own:
                out[k] = True
            else:
                self.least[key] = own
        return out


class _Sent:
    """Keys that a task lately sent, in a table with one place for each remainder: a key that many documents have need not go out under
    its own name for each run of documents. What is forgotten is merely sent again."""

    def __init__(self):
        self.key, self.h, self.state = np.zeros(KEYS, np.uint64), np.zeros(KEYS, np.int64), np.zeros(KEYS, np.uint8)

    def settled(self, key: np.ndarray, h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct keys, rows of which repeat where they differ in h: whether that is told already, and whether the row is now known to repeat.

        The row that first shows it goes out under its key, and tells all others of that key."""
        place = (key & np.uint64(KEYS - 1)).astype(np.int64)
        here = (self.key[place] == key) & (self.state[place] > 0)
        told = here & (self.state[place] == 2)
        known = known | told | here & (self.h[place] != h)
        h = np.where(here, self.h[place], h)
        self.key[place], self.h[place], self.state[place] = key, h, np.where(known, 2, 1)
        return told, known


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, h and h2 (of the words), n_words, and later: whether the same task has an earlier document with these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts()
        for batch in chunks(batches):
            digests, n = _text_digests([t.encode() for t in texts_of(batch)])
            later = firsts.later(digests, batch.column("doc_id").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _signed(digests[:, 0]), _signed(digests[:, 1]), pa.array(n.astype(np.int64)), pa.array(later)], names=["doc_id", "h", "h2", "n_words", "later"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, h long, h2 long, n_words long, later boolean")


def _zipped(docs: DataFrame) -> DataFrame:
    """docs with text compressed (__z) for the way through a shuffle, and __h as in _hashed()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = texts_of(batch)
            others = [c for c in batch.schema.names if c != "text"]
            arrays = [batch.column(c) for c in others] + [_signed(_text_digests([t.encode() for t in texts])[0][:, 0]), pa.array(list(map(_zip, texts)), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "__h", "__z"])

    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"]).add("__h", "long").add("__z", "binary")
    return docs.mapInArrow(run, schema)


def _least(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each place in at, the first place of the least of the n hashes from there."""
    return at + np.argmin(hashes[at[:, None] + np.arange(n)], axis=1)


def _starts(begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All places where a window of size words lies within one text, and the text of each."""
    n = np.maximum(np.diff(begins) - size + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begins[:-1][text], text


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows begin in which every column but the first is constant and the first counts up by one."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = columns[0][1:] != columns[0][:-1] + 1
    for c in columns[1:]:
        new = new | (c[1:] != c[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _once_each(key: np.ndarray, *also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each key goes out under it; the others know that the key repeats and go under keys of their own.

    Gives the keys to send and whether the row is known to repeat. also: where given, rows of a key repeat only if
    they differ in it."""
    if not len(key):
        return key, np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    first = np.concatenate([[True], ~same])
    group = np.cumsum(first) - 1
    many = np.bincount(group) > 1
    for column in also:
        differs = np.zeros(len(many), bool)
        values = column[order]
        np.logical_or.at(differs, group, values != values[np.flatnonzero(first)][group])
        many = differs
    known = np.empty(len(key), bool)
    known[order] = many[group]
    out = key.copy()
    rest = order[~first]
    out[rest] = mix(key[rest] + np.arange(1, len(rest) + 1, dtype=np.uint64), _SALT)
    if also:  # a repeat that nothing else confirms must still meet the rows of other tasks
        keep = rest[~known[rest]]
        out[keep] = key[keep]
    return out, known


def _level1(docs: DataFrame, keys: tuple[int, int]) -> DataFrame:
    """key, doc_id, h, run (first start << 20 | number of starts), known: five-word windows that stand for full ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, sent = _Firsts(), _Sent()
        for batch in chunks(batches):
            texts = [t.encode() for t in texts_of(batch)]
            doc, digests = batch.column("doc_id").to_numpy(), _text_digests(texts)[0]
            copy, text_hash = firsts.later(digests, doc), digests[:, 0].view(np.int64)
            (words,), begins = _word_hashes(texts, keys[:1])
            five = _five(words)
            start, text = _starts(begins, WINDOW)
            start, text = start[~copy[text]], text[~copy[text]]
            if not len(start):
                continue
            place = np.concatenate([np.argmin(x, axis=1) for x in np.array_split(sliding_window_view(five, WINDOW - BASE + 1), max(1, len(five) >> 16))])[start] + start
            first = _runs(start, place, text, start >> 19)  # a run's size must fit its 20 bits
            size = np.diff(np.append(first, len(start)))
            key, whose = five[place[first]], text[first]
            # A text that is repeated whole is no repeat; a window found twice within one text is.
            twice = np.lexsort((text_hash[whose], key))
            k, w = key[twice], whose[twice]
            within = np.zeros(len(key), bool)
            pair = (k[1:] == k[:-1]) & (w[1:] == w[:-1])
            within[twice[1:][pair]] = within[twice[:-1][pair]] = True
            out, known = _once_each(key, text_hash[whose])
            known |= within
            named = np.flatnonzero(out == key)
            named = named[np.unique(key[named], return_index=True)[1]]  # copies of a text may share a key
            told, now = sent.settled(key[named], text_hash[whose[named]], known[named])
            known[named] = now
            out[named[told]] = mix(key[named[told]] ^ mix(text_hash[whose[named[told]]].view(np.uint64) + start[first[named[told]]].astype(np.uint64)), _SALT)
            yield pa.RecordBatch.from_arrays(
                [_signed(out), batch.column("doc_id").take(pa.array(whose)), pa.array(text_hash[whose]), pa.array(((start[first] - begins[:-1][whose]) << 20 | size).astype(np.int64)), pa.array(known)],
                names=["key", "doc_id", "h", "run", "known"],
            )

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "key long, doc_id long, h long, run long, known boolean")


def _spread(runs: list[list[int]], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts (places in the chunk) in packed runs of each text, ascending and without repeats, and their texts."""
    n = np.fromiter(map(len, runs), np.int64, len(runs))
    flat = np.fromiter((r for x in runs for r in x), np.int64, int(n.sum()))
    first, size = flat >> 20, flat & 0xFFFFF
    at = np.repeat(first + begins[:-1][np.repeat(np.arange(len(runs)), n)] - np.cumsum(size) + size, size) + np.arange(size.sum())
    at = np.unique(at)
    return at, np.searchsorted(begins, at, side="right") - 1


def _level2(zipped: DataFrame, keys: tuple[int, int]) -> DataFrame:
    """From texts and their surviving runs: key, doc_id, h, known, sure, starts and hashes of full windows.

    sure: these starts go, as an earlier text of the same task has their windows; else the level decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for batch in slices(batches, 64):
            yield from level(batch, sent)

    def level(batch: pa.RecordBatch, sent: _Sent) -> Iterator[pa.RecordBatch]:
        doc, text_hash = batch.column("doc_id").to_numpy(), batch.column("__h").to_numpy()
        words, begins = _word_hashes([_unzip(z) for z in batch.column("__z").to_pylist()], keys)
        start, text = _spread(batch.column("runs").to_pylist(), begins)
        if not len(start):
            return
        fives = [_five(w) for w in words]
        tens = [_joined(f, f, BASE) for f in fives]
        a, b = (_joined(t, t, 2 * BASE)[start] for t in tens)
        five, ten = fives[0], tens[0]
        order = np.lexsort((start - begins[:-1][text], doc[text], b, a))
        ga, gb, gd, gs = a[order], b[order], doc[text][order], (start - begins[:-1][text])[order]
        head = np.concatenate([[True], (ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1])])
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        sure = np.empty(len(start), bool)
        sure[order] = (gd != gd[first]) | (gs != gs[first])
        base = _least(five, start, WINDOW - BASE + 1)
        place, least = np.zeros(len(start), np.int64), np.full(len(start), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(BASE + 1):  # ten-word windows around the five words, inside the full window
            here = base - BASE + k
            fits = (here >= start) & (here <= start + WINDOW - 2 * BASE)
            value = ten[np.clip(here, 0, len(ten) - 1)]
            better = fits & ((value < least) | (place == 0) & (least == np.uint64(0xFFFFFFFFFFFFFFFF)))
            place[better], least[better] = here[better], value[better]
        cut = _runs(start, np.where(sure, -1, place), text, start >> 19)  # a run's size must fit its 20 bits
        ends = np.append(cut[1:], len(start))
        alone = mix(start[cut].astype(np.uint64) + text_hash.view(np.uint64)[text[cut]], 7)
        key = np.where(sure[cut], alone, ten[np.minimum(place[cut], len(ten) - 1)])
        out, known = _once_each(key)
        named = np.flatnonzero((out == key) & ~sure[cut])
        told, known[named] = sent.settled(key[named], alone[named].view(np.int64), known[named])
        out[named[told]] = alone[named[told]]
        pairs = np.stack([a, b], axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                _signed(out),
                pa.array(doc[text[cut]]),
                pa.array(text_hash[text[cut]]),
                pa.array(known | sure[cut]),
                pa.array(((start[cut] - begins[:-1][text[cut]]) << 20 | (ends - cut)).astype(np.int64)),
                pa.array([None if s else pairs[i:j].tobytes() for s, i, j in zip(sure[cut], cut, ends)], pa.binary()),
            ],
            names=["key", "doc_id", "h", "known", "run", "hashes"],
        )

    return zipped.select("doc_id", "__h", "__z", "runs").mapInArrow(run, "key long, doc_id long, h long, known boolean, run long, hashes binary")


def _full_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs as rows of full windows (a, b, doc_id, h, start, size); size above 0: a run that goes for sure."""
    for batch in batches:
        doc, h, run = (batch.column(c).to_numpy() for c in ("doc_id", "h", "run"))
        hashes = batch.column("hashes").to_pylist()
        open_row = np.array([x is not None for x in hashes], bool)
        n = np.where(open_row, run & 0xFFFFF, 1)
        row = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.zeros((len(row), 2), np.uint64)
        if open_row.any():
            pairs[open_row[row]] = np.frombuffer(b"".join(x for x in hashes if x is not None), np.uint64).reshape(-1, 2)
        start, is_open = (run >> 20)[row] + nth, open_row[row]
        # All but the first of equal windows go for sure, as far as these rows tell.
        order = np.lexsort((start, doc[row], pairs[:, 1], pairs[:, 0], ~is_open))[: int(is_open.sum())]
        head = np.ones(len(order), bool)
        head[1:] = (pairs[order[1:]] != pairs[order[:-1]]).any(axis=1)
        least = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else order
        again = order[(doc[row[order]] != doc[row[least]]) | (start[order] != start[least])]
        is_open[again] = False
        size = np.where(open_row, 1, run & 0xFFFFF)[row]
        size[is_open] = 0
        closed = np.flatnonzero(~is_open)
        pairs[closed, 0], pairs[closed, 1] = doc[row[closed]].view(np.uint64), 0
        yield pa.RecordBatch.from_arrays([_signed(pairs[:, 0]), _signed(pairs[:, 1]), pa.array(doc[row]), pa.array(h[row]), pa.array(start), pa.array(size)], names=["a", "b", "doc_id", "h", "start", "size"])


def removals(docs: DataFrame) -> DataFrame:
    """Per text from which words go: doc_id, h, runs of window starts (start << 20 | number); null runs: all of it goes."""
    keys = (secrets.randbits(64), secrets.randbits(64))
    texts = written(_hashed(docs).where(f"n_words >= {WINDOW}"))
    # A task sends one document of those with the same words, so that few rows of a text meet.
    first = texts.where("NOT later").groupBy("h", "h2").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = texts.where("NOT later").join(first, ["h", "h2"]).where("doc_id > least_id")
    again = written(met.select("doc_id", "h").unionByName(texts.where("later").select("doc_id", "h")).distinct())
    by_key = Window.partitionBy("key")
    repeats = F.max("known").over(by_key) | (F.min("h").over(by_key) != F.max("h").over(by_key))
    found = _level1(docs, keys).withColumn("repeats", repeats).where("repeats").groupBy("doc_id", "h").agg(F.collect_list("run").alias("runs")).join(again, ["doc_id", "h"], "left_anti")
    joined = _zipped(docs.select("doc_id", "text").where("doc_id IS NOT NULL")).join(found.withColumnRenamed("h", "__h"), ["doc_id", "__h"])
    more = _level2(joined, keys).withColumn("n", F.count(F.lit(1)).over(by_key)).where("known OR n > 1").select("doc_id", "h", "run", "hashes")
    place = Window.partitionBy("a", "b").orderBy("doc_id", "start")
    gone = more.mapInArrow(_full_windows, "a long, b long, doc_id long, h long, start long, size long").withColumn("rank", F.rank().over(place)).where("size > 0 OR rank > 1")
    packed = F.shiftleft("start", 20).bitwiseOR(F.greatest("size", F.lit(1)))
    runs = gone.groupBy("doc_id", "h").agg(F.collect_list(packed).alias("runs"))
    return written(runs.unionByName(again.withColumn("runs", F.lit(None).cast("array<long>"))))


def _kept(text: bytes, runs: list[int] | None, gone: bool) -> tuple[int, list[bytes]]:
    """The number of words of text, and those that stay."""
    words = text.split()
    if gone and runs is None:
        return len(words), []
    if not runs:
        return len(words), words
    covered = np.zeros(len(words) + 1, np.int64)
    flat = np.array(runs, np.int64)
    start, size = flat >> 20, flat & 0xFFFFF
    np.add.at(covered, start, 1)
    np.add.at(covered, np.minimum(start + size - 1 + WINDOW, len(words)), -1)
    stay = np.cumsum(covered[:-1]) == 0
    return len(words), [w for w, s in zip(words, stay.tolist()) if s]


RESULTS = ("text", "n_words", "n_removed", "kept_sha256")


def _cut(docs: DataFrame) -> DataFrame:
    """__row (struct of the columns of docs but text) and the RESULTS."""
    gone = removals(docs).select(F.col("doc_id").alias("__id"), F.col("h").alias("__gone"), "runs")
    rows = _zipped(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("__row")))
    joined = rows.join(gone, (rows.doc_id == gone["__id"]) & (rows["__h"] == gone["__gone"]), "left").select("__row", "__z", "runs", "__gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1 << 19, "__z"):
            texts, n_words, n_gone, digest = [], [], [], []
            for z, runs, h in zip(*(batch.column(c).to_pylist() for c in ("__z", "runs", "__gone"))):
                text = _unzip(z)
                n, words = _kept(text, runs, h is not None)
                kept = b" ".join(words)
                texts.append((text if len(words) == n else kept).decode())
                n_words.append(n)
                n_gone.append(n - len(words))
                digest.append(hashlib.sha256(kept).hexdigest())
            arrays = [batch.column("__row"), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["__row", *RESULTS])

    schema = T.StructType([rows.schema["__row"]]).add("text", "string").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return joined.mapInArrow(run, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with the words that stay, joined by one blank, as text where any went (else text as it was); n_words, n_removed and
    kept_sha256 (of the words that stay, joined by one blank) are added, and stand for columns of the same names."""
    return _cut(docs).select(*[F.col("__row")[c].alias(c) for c in docs.columns if c not in RESULTS], *RESULTS)


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """docs with the words that stay as text, and n_chars to match where docs has it; a text that goes whole is left empty."""
    own = {c: F.col("__row")[c] for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return _cut(docs).select(*[own[c].alias(c) for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM w),
s AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM s),
m AS (SELECT p.doc_id, p.i, word, bool_or(coalesce(again, FALSE)) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.i = f.i),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
