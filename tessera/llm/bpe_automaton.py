"""Byte-pair encoding by a deterministic automaton.

Compiling starts with one arc between any two bytes: a place is "the last token was t", and its arcs are labelled with tokens. Each
merge (u, v) -> w, in order, adds a gadget: w gets the ways in of u and the ways out of v, and the arc from u to v goes. After all
merges, a text has exactly one path, and the labels along it are its ids. A full table of arcs would have a cell for every
pair of tokens, so the gadgets are kept as (left, right, rank), and an arc is resolved through them.

Spelling each arc's label byte by byte and taking sets of places makes the automaton deterministic over bytes: a state is the set of
(last token, bytes read since) that some arc may still go on from, and it names the token that ends here. The table has a row of 256
symbols for each state that was reached; a cell is filled when it is first asked for. Words found by the tokenizer's
pattern are encoded by stepping through the table; decoding emits the arcs' labels.

Defined results: a null text is the empty text (no ids); special tokens in a text become their ids, as the library has
it; repeated rows have equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import chunks, documents, texts_of
from tessera.llm.presplit import Encoder, WordTable, printable_bytes

#: Rows of the transition table (of a kilobyte each); beyond them it starts anew.
MOST_STATES = 1 << 17
_NEVER = 1 << 60
_UNKNOWN, _ROW = -1, array("i", [-1]) * 256


class Automaton:
    """Compiled from an ordered list of merges (left id, right id, merged id) and the ids of the single bytes."""

    def __init__(self, byte_ids: list[int], labels: dict[int, bytes], merges: list[tuple[int, int, int]], most_states: int = MOST_STATES):
        self.labels, self.most_states = labels, most_states
        self.rank = dict.fromkeys(byte_ids, -1)  # when a place came to be
        self.gadget: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}  # when an arc went
        for when, (u, v, w) in enumerate(merges):
            if w in self.rank or u not in self.rank or v not in self.rank or not self._arc(u, v, when):
                continue  # no path reaches this merge
            self.rank[w], self.gadget[w], self.cut[u, v] = when, (u, v), when
        self._spell()
        self._reset()

    def _arc(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether the arc from a to b is there when all merges below before are in."""
        while True:
            if self.cut.get((a, b), _NEVER) < before:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra == rb == -1:
                return True
            if a == b:  # both came with one gadget
                a, b, before = self.gadget[a][1], self.gadget[b][0], ra
            elif ra > rb:  # the ways out of a are those its right part had
                a, before = self.gadget[a][1], ra
            else:  # the ways into b are those its left part had, once the merged arc is gone
                b, before = self.gadget[b][0], rb + 1

    def _spell(self) -> None:
        """The labels as a tree of bytes: child of (node, byte), the token that ends at a node, whether a node has children."""
        self.size = {token: len(self.labels[token]) for token in self.rank}
        self.child: dict[int, int] = {}
        self.ends: list[int] = [_UNKNOWN]
        self.inner: list[bool] = [False]
        for token in self.rank:
            node = 0
            for c in self.labels[token]:
                self.inner[node] = True
                below = self.child.get(node << 8 | c)
                if below is None:
                    below = self.child[node << 8 | c] = len(self.ends)
                    self.ends.append(_UNKNOWN)
                    self.inner.append(False)
                node = below
            self.ends[node] = token

    def _reset(self) -> None:
        self.table = array("i")
        self.token: list[int] = []
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.start = self._state(((_UNKNOWN, 0),), _UNKNOWN)

    def _state(self, places: tuple, token: int) -> int:
        """The row of a set of (last token, node of the tree), in which token has just ended."""
        have = self.states.get(places)
        if have is None:
            have = self.states[places] = len(self.sets)
            self.sets.append(places)
            self.table.extend(_ROW)
            self.token.append(token)
        return have

    def _fill(self, state: int, c: int) -> int:
        """The state that byte c leads to, put into the table."""
        child, ends, inner = self.child, self.ends, self.inner
        ended, places = _UNKNOWN, []
        for last, node in self.sets[state]:
            below = child.get(node << 8 | c)
            if below is None:
                continue
            token = ends[below]
            if token != _UNKNOWN and (last == _UNKNOWN or self._arc(last, token)):
                ended = token  # of all paths that end here, just one is there
            if inner[below]:
                places.append((last, below))
        if len(self.sets) >= self.most_states:
            self._reset()
            return self._state((*places, (ended, 0)), ended)
        self.table[state << 8 | c] = to = self._state((*places, (ended, 0)), ended)
        return to

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path over word: one step of the table a byte, then back along the tokens that ended."""
        state, table, token, path = self.start, self.table, self.token, []
        for c in word:
            to = table[state << 8 | c]
            if to < 0:
                to = self._fill(state, c)
                table, token = self.table, self.token
            state = to
            path.append(token[to])
        out, i, size = [], len(path), self.size
        while i:
            last = path[i - 1]
            out.append(last)
            i -= size[last]
        out.reverse()
        return out


class AutomatonTokenizer:
    """A byte-level tokenizer file, compiled."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        to_byte, vocab = printable_bytes(), told["model"]["vocab"]
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        labels = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        self.automaton = Automaton([vocab[c] for c in to_byte], labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special, self.pattern = special, regex.compile(pattern)
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = max([*labels, *special.values()]) + 1
        self.label = [b""] * size
        for i, b in labels.items():
            self.label[i] = b
        for s, i in special.items():
            self.label[i] = s.encode()
        self.encoder = Encoder(WordTable(lambda word: self.automaton.encode(word.encode())), self._plain, tuple(special))

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.between.split(text) if self.between else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for word in self.pattern.findall(part):
                    out += self.automaton.encode(word.encode())
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, one after another."""
        return b"".join(map(self.label.__getitem__, ids))


@lru_cache(maxsize=1)
def compiled(path: str, pattern: str) -> AutomatonTokenizer:
    """The tokenizer of a worker, which it keeps for its later tasks."""
    return AutomatonTokenizer(path, pattern)


def encoded(docs: DataFrame, tokenizer: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (array<int>) and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compiled(tokenizer, pattern)
        digits = np.array([str(i) for i in range(len(own.label))], object)
        for batch in chunks(batches):
            ids, begins = own.encoder(texts_of(batch))
            count, of_ids, of_text, every, text = [], [], [], [], []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                part = ids[a:b]
                listed = part.tolist()
                plain = own.decode(listed).decode("utf-8", "replace").encode()
                count.append(b - a)
                of_ids.append(hashlib.sha256(",".join(digits[part]).encode()).hexdigest())
                of_text.append(hashlib.sha256(plain).hexdigest())
                if with_ids:
                    every.append(listed)
                    text.append(plain.decode())
            arrays = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_text)]
            if with_ids:
                arrays += [pa.array(every, pa.list_(pa.int32())), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
