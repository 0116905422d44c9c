"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit where over half of the hashes of a text's shingles have it. Equal fingerprints are one class. Distinct
ones within RADIUS bits agree on at least two of BLOCKS blocks of bits, so each joins a bucket for every pair of blocks; nothing
else is compared. In a bucket the fingerprints are turned into vertical bit planes: one word of a plane holds a bit of
64 fingerprints. All distances to a fingerprint are counted at once by carry-save addition into two counter planes and an overflow
plane, and a block of comparisons is abandoned when every distance in it has passed the radius. A bucket above
MOST_IN_UNIT is dealt out as pairs of its parts. Of the links in a unit of work, a spanning forest goes on to the connected components.

Defined results: a null text has no words, and fingerprint zero, as an empty one; null doc_ids are classed like others but are
no component's smallest; repeated rows share a class; of rows that share a doc_id, kept_documents() keeps or drops each on its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, documents, located, texts_of, written
from tessera.llm.components import star_roots

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Blocks of bits; at most RADIUS of them differ between linked fingerprints.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints compared all with all in one piece, and how many of small buckets are gathered for that.
MOST_IN_UNIT, GATHER = 4096, 512


def fingerprint(text: str, size: int = SHINGLE) -> int:
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z alone become lower, the six ASCII white-space characters split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(joined, SEED)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - size + 1].tolist(), end[size - 1 :].tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the columns of also, and fp (the fingerprint as a signed long) of every row."""
    schema = docs.select("doc_id", *also).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fp = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *also)), pa.array(fp)], names=schema.names)

    return docs.select("doc_id", "text", *also).mapInArrow(run, schema)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows; bit j of word w of row b is bit b of fps[64 * w + j]."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _near(planes: np.ndarray, queries: np.ndarray, passed: np.ndarray, radius: int) -> np.ndarray | None:
    """Which lanes of a block lie within radius of each query, as bits; None once every distance has passed the radius.

    planes (planes, words) and queries (planes, queries) hold the bits in one order, the latter as words of ones or noughts; passed: lanes
    that are no fingerprints, as bits."""
    one = np.zeros((queries.shape[1], planes.shape[1]), np.uint64)
    two, over = one.copy(), one | passed
    for k, (plane, query) in enumerate(zip(planes, queries)):
        x = plane ^ query[:, None]
        carry = one & x
        one ^= x
        over |= two & carry
        two ^= carry
        if k >= 15 and k % 8 == 7 and (over == _FULL).all():
            return None
    out = ~over
    if radius < 3:
        out &= ~(one & two)
    if radius < 2:
        out &= ~two
    if radius < 1:
        out &= ~one
    return out


def links(fps: np.ndarray, radius: int = RADIUS, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of all fingerprints within radius (at most 3) of one another.

    64 fingerprints at a time are compared with themselves, and then with those after them in blocks of so many words of 64. Bits in
    which the fingerprints differ most are counted first, so that blocks are abandoned early."""
    if radius > 3:
        raise ValueError("two counter planes count to three")
    n, planes = len(fps), bit_planes(fps)
    order = np.argsort(np.abs(2 * np.bitwise_count(planes).sum(axis=1, dtype=np.int64) - n), kind="stable")
    planes, passed = planes[order], np.zeros(planes.shape[1], np.uint64)
    if n % 64:
        passed[-1] = _FULL << np.uint64(n % 64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for word in range(planes.shape[1]):
        mine = fps[64 * word : 64 * word + 64]
        queries = np.where((mine >> order.astype(np.uint64)[:, None]) & np.uint64(1), _FULL, np.uint64(0))
        for first, last in [(word, word + 1), *((k, k + block) for k in range(word + 1, planes.shape[1], block))]:
            near = _near(planes[:, first:last], queries, passed[first:last], radius)
            if near is None:
                continue
            i, j = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
            i, j = i + 64 * word, j + 64 * first
            left.append(i[j > i])
            right.append(j[j > i])
    return np.concatenate(left), np.concatenate(right)


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Some of the edges (i, j), with the same components and no cycle."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            kept.append((a, b))
    return kept


def _linked_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, unit, fp) sorted by key and unit -> edges (a, b) between fingerprints."""

    def edges(parts: list[np.ndarray]) -> pa.RecordBatch:
        fps = np.unique(np.concatenate(parts))
        found = forest(*links(fps.view(np.uint64)))
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fps[at[:, 0]]), pa.array(fps[at[:, 1]])], names=["a", "b"])

    held: list[np.ndarray] = []
    last, open_parts = None, []
    for batch in batches:
        key, unit, fp = (batch.column(c).to_numpy() for c in ("key", "unit", "fp"))
        if not len(key):
            continue
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        # Runs of one row end here unless they may go on from the last batch or into the next one.
        some = np.flatnonzero((end - begin > 1) | (begin == 0) | (end == len(key)))
        for a, b in zip(begin[some].tolist(), end[some].tolist()):
            own = (key[a], unit[a])
            if own != last:
                if sum(map(len, open_parts)) > 1:
                    held += open_parts
                    if sum(map(len, held)) >= GATHER:
                        yield edges(held)
                        held = []
                last, open_parts = own, []
            open_parts.append(fp[a:b])
    if sum(map(len, open_parts)) > 1:
        held += open_parts
    if held:
        yield edges(held)


def link_forest(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect whatever is linked among the distinct fingerprints of classes (column fp)."""
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    block = lambda k: F.shiftrightunsigned("fp", starts[k]).bitwiseAND(F.lit((1 << BLOCKS[k]) - 1))
    keys = [F.lit(t << 32).bitwiseOR(F.shiftleft(block(a), BLOCKS[b])).bitwiseOR(block(b)) for t, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))]
    rows = classes.select("fp", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_IN_UNIT)
    parts = F.ceil(F.col("n") / MOST_IN_UNIT)
    own = F.pmod(F.xxhash64("fp"), parts)
    # Unit i * parts + j compares parts i and j; a part takes part in one unit with each.
    units = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda o: F.least(o, own) * parts + F.greatest(o, own))
    dealt = rows.join(large, "key", "left").select("key", "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(units)).alias("unit"))
    return dealt.repartition("key", "unit").sortWithinPartitions("key", "unit").mapInArrow(_linked_units, "a long, b long")


def _classed(rows: DataFrame, *who: str) -> DataFrame:
    """rows (fp, and the columns who) with keep: the least who of all rows that are reachable, where null counts as greatest."""
    rank = F.struct(*[x for c in who for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    classes = written(rows.groupBy("fp").agg(F.min(rank).alias("least")))
    star = star_roots(link_forest(classes))
    root = classes.join(star, classes.fp == star.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("keep"))
    return rows.join(root.join(least, "root").select("fp", "keep"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    rows = written(fingerprints(docs))
    return _classed(rows, "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keep.doc_id").alias("component_id"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of docs of each component, with all its columns: the one of smallest doc_id, and of rows that share it the one that is stored first."""
    place = located(docs)
    rows = written(fingerprints(place.select("doc_id", "text", "__at"), "__at"))
    gone = _classed(rows, "doc_id", "__at").where("NOT (doc_id <=> keep.doc_id AND __at = keep.__at)").select("__at")
    return place.join(gone, "__at", "left_anti").select("__row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
