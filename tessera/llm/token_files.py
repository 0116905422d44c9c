"""Token ids in files of patched frame-of-reference blocks.

A segment is a complete file image: a header, an index of where each block starts, then the blocks. A block holds up
to BLOCK ids as their differences to the block's minimum, packed at the width that PERCENTILE of them need; the others
are exceptions, kept in a list of (place, high bits) at the block's end. Segments follow one another in ascending doc_id
order. They are written as rows of a Parquet table (part, segment, image), so that Spark's commit protocol covers them
and any store that Spark can write to will do.

Layout, little-endian: magic "TPFR", version u16, block size u16, documents u32, ids u64, blocks u32; document lengths
u32 each; byte starts of the blocks u32 each, and one for the end; a block: minimum u32, width u8, exceptions u16, ids
u16, packed bits, then places u16 each and high bits u32 each.

Defined results: a null text is the empty text, of which only the end id remains; equal doc_ids are put in order by
their texts; null doc_ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, documents, texts_of, written

BLOCK = 256
PERCENTILE = 0.95
SEGMENT_IDS = 1 << 20
END_ID = 2
MAGIC, VERSION = b"TPFR", 1
_HEAD, _BLOCK_HEAD = struct.Struct("<4sHHIQI"), struct.Struct("<IBHH")


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low width bits of each row's values one after another, as rows of bytes; 64 bits are filled at a time."""
    words = np.zeros((-(-values.shape[1] * width // 64) + 1, len(values)), np.uint64)
    for k, column in enumerate(np.ascontiguousarray(values.T).astype(np.uint64)):
        at, shift = divmod(k * width, 64)
        words[at] |= column << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)


def _unpacked_bits(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    """The n values of width bits of each row of bytes."""
    padded = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8 + 8), np.uint8)
    padded[:, : raw.shape[1]] = raw
    words = padded.view("<u8")
    at, shift = np.divmod(np.arange(n) * width, 64)
    out = words[:, at] >> shift.astype(np.uint64)
    over = np.flatnonzero(shift + width > 64)
    out[:, over] |= words[:, at[over] + 1] << (64 - shift[over]).astype(np.uint64)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids."""
    n = len(ids)
    if not n:
        return []
    n_blocks = -(-n // BLOCK)
    grid = np.full(n_blocks * BLOCK, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(n_blocks, BLOCK)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    bits = _bit_lengths(diff)
    width = np.sort(bits, axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
    used = np.full(n_blocks, BLOCK)
    used[-1] = n - (n_blocks - 1) * BLOCK
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            body = _packed_bits(diff[rows] & np.uint32((1 << w) - 1), w)
            for r, x in zip(rows.tolist(), body):
                packed[r] = x[: -(-int(used[r]) * w // 8)].tobytes()
    high = diff >> width[:, None].astype(np.uint32)
    high[-1, used[-1] :] = 0
    row, place = np.nonzero(high)
    cut = np.searchsorted(row, np.arange(n_blocks + 1))
    place, value = place.astype("<u2"), high[row, place].astype("<u4")
    out = []
    for b, (lo, w, u) in enumerate(zip(low.tolist(), width.tolist(), used.tolist())):
        i, j = cut[b], cut[b + 1]
        out.append(_BLOCK_HEAD.pack(lo, w, j - i, u) + packed[b] + place[i:j].tobytes() + value[i:j].tobytes())
    return out


def encode_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u4")
    return _HEAD.pack(MAGIC, VERSION, BLOCK, len(lengths), len(ids), len(blocks)) + np.asarray(lengths).astype("<u4").tobytes() + starts.tobytes() + b"".join(blocks)


def decode_segment(image: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the blocks first to last (all: by default), and the documents' lengths."""
    magic, version, block, n_docs, n_ids, n_blocks = _HEAD.unpack_from(image)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    lengths = np.frombuffer(image, "<u4", n_docs, at)
    starts = np.frombuffer(image, "<u4", n_blocks + 1, at + 4 * n_docs)
    base = at + 4 * n_docs + 4 * (n_blocks + 1)
    chosen = range(first, n_blocks if last is None else min(last, n_blocks))
    grid = np.zeros((len(chosen), block), np.uint32)
    heads = [_BLOCK_HEAD.unpack_from(image, base + int(starts[b])) for b in chosen]
    width = np.array([h[1] for h in heads], np.int64)
    whole = np.frombuffer(image, np.uint8)
    body = base + starts[first : first + len(chosen)].astype(np.int64) + _BLOCK_HEAD.size
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            size = block * w // 8 if block * w % 8 == 0 else -(-block * w // 8)
            take = body[rows][:, None] + np.arange(size)
            raw = whole[np.minimum(take, len(whole) - 1)]  # a short last block reads on; what it reads is cut off below
            grid[rows] = _unpacked_bits(raw, w, block)
    for r, (lo, w, n_odd, used) in enumerate(heads):
        if n_odd:
            at = int(body[r]) + -(-used * w // 8)
            place = np.frombuffer(image, "<u2", n_odd, at)
            grid[r, place] |= np.frombuffer(image, "<u4", n_odd, at + 2 * n_odd) << np.uint32(w)
    grid += np.array([h[0] for h in heads], np.uint32)[:, None] if heads else np.uint32(0)
    return np.concatenate([grid[r, : h[3]] for r, h in enumerate(heads)]) if heads else np.zeros(0, np.uint32), lengths


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """The files as a stored table: part, segment, ids_before (in the part), n_ids, doc_ids, image."""
    schema = "part int, segment int, ids_before long, n_ids long, doc_ids array<long>, image binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.presplit import library_encoder

        encode = library_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        doc_ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        segment = before = n_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, held, segment, before, n_held
            doc = pa.concat_arrays(doc_ids)
            image = encode_segment(np.concatenate(held), np.concatenate(lengths))
            listed = pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before]), pa.array([n_held]), listed, pa.array([image], pa.binary())], names=names)
            doc_ids, lengths, held, segment, before, n_held = [], [], [], segment + 1, before + n_held, 0
            return row

        for batch in chunks(batches):
            ids, begins = encode.with_end(texts_of(batch), end_id)
            done = 0
            while done < batch.num_rows:  # as many documents as fill the segment, the last of which may pass its bound
                last = min(batch.num_rows, int(np.searchsorted(begins, begins[done] + segment_ids - n_held)))
                doc_ids.append(batch.column("doc_id").slice(done, last - done))
                lengths.append(np.diff(begins[done : last + 1]))
                held.append(ids[begins[done] : begins[last]])
                n_held += int(begins[last] - begins[done])
                done = last
                if n_held >= segment_ids:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, schema))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the images: doc_id, start, n_tokens, ids_crc32."""
    # One row per part, of which the range partitioner makes no more than spark.sql.shuffle.partitions.
    spark = files.sparkSession
    totals = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    begins = np.cumsum([0, *(n for _, n in totals)]).tolist()
    before = F.broadcast(spark.createDataFrame([(p, b) for (p, _), b in zip(totals, begins)], "part int, part_begins long"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = decode_segment(batch.column("image")[row].as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                at = batch.column("part_begins")[row].as_py() + batch.column("ids_before")[row].as_py()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(begins + at), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.join(before, "part").select("part_begins", "ids_before", "doc_ids", "image").mapInArrow(run, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
