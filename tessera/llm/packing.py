"""Cost-balanced packing of documents into fixed-length training sequences.

A sequence's cost is estimated as linear * tokens + quadratic * (sum of the squares of its pieces), the latter for
attention within pieces. Documents are taken in groups of bounded size as they are read; in each group, pieces in descending
length go to the sequence of lowest cost that has room, and where no sequence has room for all of a piece it is cut. The
group's sequences hold exactly its tokens: as many full ones as fit, and the rest in sequences whose lengths are
powers of two, so nothing is padded. Sequences are numbered within the partition that makes them; there is no shuffle.

Defined results: a null or empty text is a document of its end id alone; repeated rows and doc_ids are packed once
each; of pieces of equal length the one read first goes first, and of sequences of equal cost the first takes it; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import chunks, documents, texts_of

SEQUENCE = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that are packed together; bounds a task's memory.
GROUP_TOKENS = 1 << 20
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def room_for(total: int, size: int) -> np.ndarray:
    """Lengths of the sequences that hold total tokens exactly: full ones, then falling powers of two."""
    full, rest = divmod(total, size)
    return np.array([size] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def pack(lengths: np.ndarray, size: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and each sequence's length and cost."""
    whole = lengths // size
    rest = lengths - whole * size
    n_whole = int(whole.sum())
    room = room_for(int(lengths.sum()), size)
    pieces: list[tuple[int, int, int, int, int]] = []
    of = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(n_whole) - np.repeat(np.cumsum(whole) - whole, whole)
    pieces += [(d, k * size, size, s, 0) for s, (d, k) in enumerate(zip(of.tolist(), nth.tolist()))]
    cost = np.zeros(len(room))
    cost[:n_whole] = linear * size + quadratic * size * size
    open_room, open_cost = room[n_whole:].copy(), cost[n_whole:]
    for d in np.argsort(-rest, kind="stable").tolist():
        left, start = int(rest[d]), int(whole[d]) * size
        while left:
            fits = open_room >= left
            s = int(np.argmin(np.where(fits, open_cost, np.inf))) if fits.any() else int(np.argmax(open_room))
            n = min(left, int(open_room[s]))
            pieces.append((d, start, n, n_whole + s, int(room[n_whole + s] - open_room[s])))
            open_room[s] -= n
            open_cost[s] += linear * n + quadratic * n * n
            left, start = left - n, start + n
    return pieces, room, cost


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = SEQUENCE, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves (array<int>)."""
    schema = SCHEMA + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.presplit import library_encoder

        encode = library_encoder(tokenizer)
        next_sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        doc_ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence, doc_ids, lengths, held, n_held
            doc, length, ids = pa.concat_arrays(doc_ids), np.concatenate(lengths), np.concatenate(held).astype("<u4")
            pieces, room, cost = pack(length, size)
            d, start, n, s, at = np.array(sorted(pieces, key=lambda p: (p[3], p[4])), np.int64).T
            begin = (np.cumsum(length) - length)[d] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + n).tolist())]
            arrays = [doc.take(pa.array(d)), *map(pa.array, (start, n, np.array(crc, np.int64), length[d], next_sequence + s, at, room[s], cost[s]))]
            if with_ids:
                arrays.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(begin.tolist(), (begin + n).tolist())], pa.list_(pa.int32())))
            next_sequence += len(room)
            doc_ids, lengths, held, n_held = [], [], [], 0
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in chunks(batches):
            ids, begins = encode.with_end(texts_of(batch), end_id)
            done = 0
            while done < batch.num_rows:  # as many documents as fill the group, the last of which may pass its bound
                last = min(batch.num_rows, int(np.searchsorted(begins, begins[done] + group_tokens - n_held)))
                doc_ids.append(batch.column("doc_id").slice(done, last - done))
                lengths.append(np.diff(begins[done : last + 1]))
                held.append(ids[begins[done] : begins[last]])
                n_held += int(begins[last] - begins[done])
                done = last
                if n_held >= group_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
