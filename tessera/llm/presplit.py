"""Words of byte-pair tokenizers, found for many texts at once, and a table of the ids of every word seen.

Texts whose characters all lie below FAST take the vectorised way: character classes come from a table, and the boundaries
follow from where the classes change. A word is looked up in an open-addressing table by a hash of its blocks of four characters,
and every hit is verified block by block; what does not agree, and words above LONG characters, are encoded on their own. Any other text is
split at white space into pieces that byte-pair tokenizers of these kinds never join: a run of other characters with the one
white-space character before it, or what else there is of a run of white space. Texts that hold a special token take the plain way,
as do all texts of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cache, lru_cache

import numpy as np
import regex

from tessera.llm.common import mix

#: Characters below this code point are composed, have no combining marks, and lower to one character each but for U+0130.
FAST = 0x250
SLOW = re.compile("[^\0-\u012f\u0131-\u024f]")
#: The characters of Unicode's property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{WHITE}]?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])")
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: Words that a worker remembers, slots of their table, and characters of the pieces it remembers; beyond these it starts anew.
MOST_WORDS, SLOTS, MOST_CHARS = 1_000_000, 1 << 21, 16_000_000
LONG = 64


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def _classes() -> np.ndarray:
    kinds = ((_LETTER, regex.compile(r"\p{L}")), (_NUMBER, regex.compile(r"\p{N}")), (_SPACE, regex.compile(r"\s")))
    return np.array([next((k for k, p in kinds if p.fullmatch(chr(c))), _OTHER) for c in range(FAST)], np.uint8)


def byte_level_spans(chars: np.ndarray, begins: np.ndarray, spaced: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts, which lie in chars one after another; begins: where each text begins.

    spaced: a blank before a word belongs to it, and other white space makes words too (the pattern of byte-level
    tokenizers); else white space is dropped and every number is a word of its own.
    """
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _classes()[chars]
    first = np.zeros(n, bool)  # of its text
    first[begins[begins < n]] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= first
    if not spaced:
        change |= kind == _NUMBER
    # A run that is one apostrophe, and no blank joins it: a contraction may follow.
    lone = np.flatnonzero((chars[:-2] == 39) & change[:-2] & change[1:-1] & ~first[1:-1]) if n > 2 else np.zeros(0, np.int64)
    if n > 1 and chars[n - 2] == 39 and change[n - 2] and change[n - 1] and not first[n - 1]:
        lone = np.append(lone, n - 2)
    if spaced and len(lone):
        lone = lone[(lone == 0) | first[lone] | (chars[lone - 1] != 32)]
    if len(lone):
        a = chars[lone + 1]
        b = np.where((lone + 2 < n), chars[np.minimum(lone + 2, n - 1)], 0)
        b[(lone + 2 < n) & first[np.minimum(lone + 2, n - 1)]] = 0
        size = np.zeros(len(lone), np.int64)
        size[np.isin(a, [115, 116, 109, 100])] = 1  # s t m d
        size[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)] = 2  # re ve ll
        lone, size = lone[size > 0], size[size > 0]
        change[lone + 1] = False
        after = lone + 1 + size
        inside = after < n
        change[after[inside]] = True
        if len(lone):
            change[lone[size == 2] + 2] = False
    if spaced:
        blank_run = kind == _SPACE
        # The last white-space character before a word: a blank joins the word, another is a word of its own.
        before = np.flatnonzero(blank_run[:-1] & ~blank_run[1:] & ~first[1:])
        change[before] = True
        joins = before[chars[before] == 32]
        change[joins + 1] = False
        start = np.flatnonzero(change)
        return start, np.append(start[1:], n)
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    word = kind[start] != _SPACE
    return start[word], end[word]


def _grown(have: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """have with more put after its first used entries; room is doubled when it runs out."""
    if used + len(more) > len(have):
        wider = np.zeros(max(used + len(more), 2 * len(have)), have.dtype)
        wider[:used] = have[:used]
        have = wider
    have[used : used + len(more)] = more
    return have


_KEEP = np.array([(1 << 16 * k) - 1 for k in range(5)], np.uint64)


class WordTable:
    """Ids of words, filled by encode(word) as words come up."""

    def __init__(self, encode: Callable[[str], list[int]], spaced: bool = True, lower: bool = False):
        self.encode, self.spaced, self.lower = encode, spaced, lower
        self.clear()

    def clear(self) -> None:
        self.slot_key, self.slot_word = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)  # the word's number, and one more
        self.n = self.n_ids = self.n_blocks = 0
        self.size, self.first, self.length, self.block = (np.zeros(1 << 12, np.int64) for _ in range(4))
        self.ids, self.blocks = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint64)

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, and where each text's ids begin (one more entry than texts). No text may have SLOW characters."""
        if self.n > MOST_WORDS:
            self.clear()
        wide = "".join(texts)
        if self.lower:
            wide = wide.lower()
        chars = np.frombuffer(wide.encode("utf-16-le"), np.uint16)
        begins = np.cumsum([0, *map(len, texts)])
        start, end = byte_level_spans(chars, begins[:-1], self.spaced)
        size = end - start
        hashes, blocks = self._hashed(chars, start, size)
        short = size <= LONG
        word = self._find(hashes)
        new = np.flatnonzero((word < 0) & short)
        if len(new):
            unique, at, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[at]
            self._add(unique, [wide[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())], size[at], self._blocks_of(blocks, at, size[at]))
            word[new] = (self.n - len(unique)) + back
        same = short.copy()
        word[~short] = 0
        np.logical_and(same, self.size[word] == size, out=same)
        for k, (which, value) in enumerate(blocks):
            same[which] &= self.blocks[np.minimum(self.block[word[which]] + k, len(self.blocks) - 1)] == value
        length, first, ids = self.length[word], self.first[word], self.ids
        alone = np.flatnonzero(~same)
        if len(alone):
            coded = [self.encode(wide[a:b]) for a, b in zip(start[alone].tolist(), end[alone].tolist())]
            length[alone] = np.fromiter(map(len, coded), np.int64, len(coded))
            first[alone] = len(ids) + np.cumsum(length[alone]) - length[alone]
            ids = np.concatenate([ids, np.array([i for c in coded for i in c], np.uint32)])
        total = np.concatenate([[0], np.cumsum(length)])
        return ids[np.arange(total[-1]) + np.repeat(first - total[:-1], length)], total[np.searchsorted(start, begins)]

    def _hashed(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """A hash of each word, and its blocks of four characters: for each place in a word, which words have it, and the block."""
        wide = np.zeros(len(chars) + 3, np.uint64)
        wide[: len(chars)] = chars
        wide[:-1] |= wide[1:] << np.uint64(16)  # two characters at a place, then four
        wide[:-2] |= wide[2:] << np.uint64(32)
        hashes, blocks = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), []
        which = np.flatnonzero(size <= LONG)
        for k in range(0, LONG, 4):
            which = which[size[which] > k] if k else which
            if not len(which):
                break
            value = wide[start[which] + k] & _KEEP[np.minimum(size[which] - k, 4)]
            blocks.append((which, value))
            hashes[which] = mix(hashes[which] ^ value)
        return hashes, blocks

    @staticmethod
    def _blocks_of(blocks: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The blocks of the words at, word after word."""
        n = -(-size // 4)
        out, begin = np.zeros(int(n.sum()), np.uint64), np.cumsum(n) - n
        for k, (which, value) in enumerate(blocks):
            has = np.flatnonzero(n > k)
            out[begin[has] + k] = value[np.searchsorted(which, at[has])]
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the word in the table under each hash, or -1."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        word = self.slot_word[slot].astype(np.int64) - 1
        look = np.flatnonzero((word >= 0) & (self.slot_key[slot] != hashes))
        while len(look):
            slot[look] = (slot[look] + 1) & (SLOTS - 1)
            word[look] = self.slot_word[slot[look]].astype(np.int64) - 1
            look = look[(word[look] >= 0) & (self.slot_key[slot[look]] != hashes[look])]
        return word

    def _add(self, hashes: np.ndarray, words: list[str], size: np.ndarray, blocks: np.ndarray) -> None:
        """Words under hashes that the table does not have."""
        coded = [self.encode(w) for w in words]
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.array([i for c in coded for i in c], np.uint32)
        n_blocks = -(-size // 4)
        number = np.arange(self.n, self.n + len(words))
        self.size, self.length = _grown(self.size, self.n, size), _grown(self.length, self.n, length)
        self.first = _grown(self.first, self.n, self.n_ids + np.cumsum(length) - length)
        self.block = _grown(self.block, self.n, self.n_blocks + np.cumsum(n_blocks) - n_blocks)
        self.ids, self.blocks = _grown(self.ids, self.n_ids, flat), _grown(self.blocks, self.n_blocks, blocks)
        self.n, self.n_ids, self.n_blocks = self.n + len(words), self.n_ids + len(flat), self.n_blocks + len(blocks)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.slot_word[slot[todo]] == 0]
            self.slot_word[slot[free]] = number[free] + 1  # of several, one has the slot
            won = free[self.slot_word[slot[free]] == number[free] + 1]
            self.slot_key[slot[won]] = hashes[won]
            todo = todo[self.slot_word[slot[todo]] != number[todo] + 1]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)


class Encoder:
    """Ids of whole texts: from the table of words, by remembered pieces, or by plain(text)."""

    def __init__(self, words: WordTable | None, plain: Callable[[str], list[int]], special: tuple[str, ...]):
        self.words, self.plain, self.special = words, plain, special
        self.pieces: dict[str, list[int]] = {}
        self.n_chars = 0

    def _by_pieces(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in PIECE.findall(text):
            if (ids := self.pieces.get(piece)) is None:
                ids = self.plain(piece)
                if len(piece) <= LONG:
                    if self.n_chars > MOST_CHARS:
                        self.pieces.clear()
                        self.n_chars = 0
                    self.pieces[piece] = ids
                    self.n_chars += len(piece)
            out += ids
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more entry than texts)."""
        if self.words is None:
            parts = [np.array(self.plain(t), np.uint32) for t in texts]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])
        special = [any(s in t for s in self.special) for t in texts]
        slow = [s or SLOW.search(t) is not None for t, s in zip(texts, special)]
        ids, begins = self.words.ids_of([t for t, s in zip(texts, slow) if not s])
        if not any(slow):
            return ids, begins
        parts, k = [], 0
        for t, s, whole in zip(texts, slow, special):
            parts.append(np.array(self.plain(t) if whole else self._by_pieces(t), np.uint32) if s else ids[begins[k] : begins[k + 1]])
            k += not s
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def with_end(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As a call, with end_id after the ids of each text."""
        ids, begins = self(texts)
        return np.insert(ids, begins[1:], end_id), begins + np.arange(len(begins))


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """The tokenizers library with the tokenizer file at path; add_special_tokens is off. A worker keeps it for its later tasks."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = tuple(x["content"] for x in told["added_tokens"])
    normal, split = json.dumps(told.get("normalizer")), told.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [split])
    kinds = [x.get("type") for x in steps]
    spaced = normal == "null" and kinds == ["ByteLevel"] and split["use_regex"] and not split["add_prefix_space"]
    spaceless = "Lowercase" in normal and kinds == ["Split", "ByteLevel"] and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in str(steps[0]["pattern"].get("Regex"))
    told_by = {b: c for c, b in printable_bytes().items()}
    as_told = str.maketrans({chr(c): "".join([told_by[b] for b in chr(c).encode()]) for c in range(FAST)})
    tokenize = tokenizer.model.tokenize

    def word(w: str) -> list[int]:
        return [t.id for t in tokenize(w.translate(as_told))]

    def plain(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    return Encoder(WordTable(word, spaced, spaceless) if spaced or spaceless else None, plain, special)
