"""Each operator against brute force, on documents with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tessera.llm import bpe_automaton, chat_format, exact_dedup, packing, presplit, quality_model, quality_rules, simhash, substring_dedup, token_files, toxicity
from tessera.llm.components import star_roots

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, runs string, fp string, digest string, keep string, n_words int, who string, x double, g string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts() -> list[tuple[int, str | None]]:
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeioustrn") for _ in range(rnd.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    long = prose(6000)
    out = [None, "", " \t\n", "One", "one", "ONE two", "<|endoftext|> aé 日本 'İ", "it's we'll 'S 12²  \n\n x", long, long, long + " end", "x " * 3000]
    out += [prose(80) + "\n" + passage + " " + prose(5) for _ in range(4)] + [prose(rnd.randrange(1, 120)) for _ in range(25)]
    base = prose(300).split()
    for k in range(5):
        base[k * 7] = word()
        out.append(" ".join(base))
    out += ["ÄÖ café " + prose(30), "### " * 60, prose(55).upper()]
    return list(enumerate(out))


DOCS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", len(t or ""), 1, "r", "f", "d", "k", 3, "w", 0.5, "g") for i, t in DOCS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_exact_dedup(docs, none):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    norm = {i: (t or "").translate(UP) for i, t in DOCS}
    for i, t in norm.items():
        same = [j for j in norm if norm[j] == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), sha(t))
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in norm if got[i].kept)


def test_exact_dedup_when_digests_collide(spark):
    from pyspark.sql import functions as F

    rows = [(1, "aB"), (2, "Ab"), (2, "Ab"), (5, "abd"), (None, "abd"), (6, "abX"), (7, "ABx"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    weak = lambda c: F.unhex(F.sha2(F.substring(c, 1, 2), 256))
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, digest=weak, files_per_batch=1).collect())
    assert got == sorted([("1", 2, 3, False), ("2", 2, 3, True), ("2", 2, 3, False), ("5", 5, 2, True), ("None", 5, 2, False), ("6", 7, 2, False), ("7", 7, 2, True), ("8", 8, 1, True)])


def test_exact_dedup_of_any_plan(spark, tmp_path):
    """Unions, joins and clashing names; rows are told apart wherever they come from."""
    rows = [(i, f"Text {i % 5}", "f", 7, "m") for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, __file string, __row long, _metadata string").repartition(2).write.parquet(f"{tmp_path}/a")
    one = spark.read.parquet(f"{tmp_path}/a")
    for df, copies in ((one, 1), (one.unionByName(one), 2), (one.join(spark.range(3).withColumnRenamed("id", "k")), 3), (one.where("doc_id >= 0"), 1)):
        kept = exact_dedup.kept_documents(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 8, 9]
        assert {r.group_size for r in exact_dedup.exact_dedup(df).collect()} == {2 * copies}


def test_exact_dedup_goes_on_from_a_state(spark, tmp_path):
    from pyspark.sql import functions as F

    state, schema = f"{tmp_path}/state", "doc_id long, text string, other int"
    first = spark.createDataFrame([(1, "Aa", 1), (2, "aA", 1), (5, "b", 1), (6, "abX", 1)], schema)
    second = spark.createDataFrame([(3, "aa", 2), (4, "B", 2), (7, "c", 2), (8, "aby", 2)], schema)
    weak = lambda c: F.unhex(F.sha2(F.substring(c, 1, 2), 256))
    run = lambda df: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, digest=weak, state=state).collect())
    assert run(first) == [(1, 2, 2, False), (2, 2, 2, True), (5, 5, 1, True), (6, 6, 1, True)]
    # aa is the third of its text, b was seen under a larger doc_id, and aby shares a digest with abX alone.
    assert run(second) == [(3, 3, 3, True), (4, 5, 2, False), (7, 7, 1, True), (8, 8, 1, True)]
    assert sorted(r.doc_id for r in exact_dedup.kept_documents(spark.createDataFrame([(9, "C", 3), (10, "new", 3)], schema), state=state).collect()) == [9, 10]


def brute_fingerprint(text: str) -> int:
    w = WORDS.findall(text.translate(UP))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    fps = {i: brute_fingerprint(t or "") for i, t in DOCS}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] > root[j]:
                    root[i], changed = root[j], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    assert simhash.near_duplicates(none).count() == 0
    assert sorted(r.doc_id for r in simhash.kept_documents(docs).collect()) == sorted(i for i in root if root[i] == i)


def test_blocks_are_abandoned(monkeypatch):
    """Blocks of random fingerprints, in which nothing is near, are left before all planes are counted; the near pair is still found."""
    left, plain = [], simhash._near
    monkeypatch.setattr(simhash, "_near", lambda *a: (left.append(out := plain(*a)), out)[1])
    x = np.random.default_rng(3).integers(0, 1 << 63, 4096, dtype=np.uint64)
    x[4000] = x[17] ^ np.uint64(0b10000000100000001)
    i, j = simhash.links(x, block=16)
    assert list(zip(i, j)) == [(17, 4000)]
    gone = sum(out is None for out in left)
    assert len(left) == 64 + sum(-(-k // 16) for k in range(64)) and gone >= 0.95 * (len(left) - 64)


def test_simhash_keeps_rows_that_share_a_doc_id(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "quite another text here"), (3, "x y z"), (3, "x y z"), (None, "only without an id"), (None, "only without an id")]
    kept = sorted((str(r.doc_id), r.text) for r in simhash.kept_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == sorted([("1", "a b c d e"), ("2", "quite another text here"), ("3", "x y z"), ("None", "only without an id")])


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 300):
        x = rng.integers(0, 1 << 63, max(1, n // 4), dtype=np.uint64)[rng.integers(0, max(1, n // 4), n)]
        for _ in range(4):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.5).astype(np.uint64)
        i, j = np.nonzero((np.bitwise_count(x[:, None] ^ x[None]) <= radius) & (np.arange(n)[:, None] < np.arange(n)[None]))
        a, b = simhash.links(x, radius)
        assert sorted(zip(i, j)) == sorted(zip(a, b))


def test_large_buckets_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_IN_UNIT", 16)
    fps = sorted({5 ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)})
    star = star_roots(simhash.link_forest(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    assert {r.node for r in star} == set(fps[1:]) and {r.root for r in star} == {fps[0]}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(15)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in star_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}
    assert star_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_substrings(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone[k : k + 20] = [True] * 20
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substring_dedup(docs, none, spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.cleaned(docs).collect()}
    assert got == brute_substrings(DOCS) and sum(n > 0 for _, n, _ in got.values()) > 5
    out = substring_dedup.cleaned_documents(docs)
    assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in out.where("text IS NOT NULL").collect())
    assert substring_dedup.cleaned(none).count() == 0
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 90)))) for i in range(200)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 320)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute_substrings(rows)
    odd = spark.createDataFrame([(None, "w " * 40), (None, "w " * 40), (1, "w " * 40)], "doc_id long, text string")
    # 21 windows of which 20 start later: all words but none of the first window's alone go.
    assert sorted(r.n_removed for r in substring_dedup.cleaned(odd).collect()) == [0, 0, 39]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_presplit_gives_the_librarys_ids(path):
    rnd, plain = random.Random(5), Tokenizer.from_file(path)
    low = "ab  \n\t'''strevmldSTé. !12²ß½ \x85\xa0\x1c\x1fÄ\r\v\f"
    high = low + "\u2003\u3000\u180e\u200b\ufeff日本\u0301Σς한\u0130\u212b"
    these = [t or "" for _, t in DOCS] + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 30))) for letters in (low, high) for _ in range(3000)]
    encode = presplit.library_encoder(path)
    for k in range(0, len(these), 500):
        ids, begins = encode(these[k : k + 500])
        for t, a, b in zip(these[k : k + 500], begins, begins[1:]):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def thue_morse(n: int, a: str, b: str) -> list[str]:
    return [b if k.bit_count() % 2 else a for k in range(n)]


LONG_WORDS = ["".join(thue_morse(n, *ab)) for n in (1024, 4096) for ab in ("ab", "ba")] + ["x" * 500_000, "é" * 70_000, "ab " * 200_000]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_are_known_by_their_characters(path):
    """Words on which polynomial hashes collide, and texts of megabytes."""
    plain, encode = Tokenizer.from_file(path), presplit.library_encoder(path)
    for texts in ([t] for t in LONG_WORDS), [LONG_WORDS]:
        for these in texts:
            ids, begins = encode(these)
            assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in these]


def test_words_whose_hashes_collide(monkeypatch):
    """With a hash that tells nothing apart, and a table that is full at once, every word still has its own ids."""
    monkeypatch.setattr(presplit, "mix", lambda x: np.zeros_like(x))
    monkeypatch.setattr(presplit, "MOST_WORDS", 3)
    table = presplit.WordTable(lambda w: [ord(c) for c in w])
    for text in ("ab cd ef abcde fghij", "cd xy zz abcde", "", "ab abcde fghij cd"):
        assert "".join(map(chr, table.ids_of([text])[0])) == text


def test_automaton_on_long_words(spark):
    rows = list(enumerate(LONG_WORDS))
    got = {r.doc_id: r for r in bpe_automaton.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), BYTE, public_tokenizers.PATTERN).collect()}
    plain = Tokenizer.from_file(BYTE)
    for i, t in rows:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert (got[i].ids_sha256, got[i].decoded_sha256) == (sha(",".join(map(str, ids))), sha(t))


def test_substrings_on_which_polynomials_collide(spark):
    x, y = "xenon", "ytter"
    rows = [(k, " ".join(f"{c} u{n}" for n, c in enumerate(thue_morse(2048, *ab)))) for k, ab in enumerate(((x, y), (y, x)))]
    rows += [(k + 10, " ".join(thue_morse(4096, *ab))) for k, ab in enumerate(((x, y), (y, x)))]
    rows += [(20, "w" * 300 + " " + rows[0][1]), (21, "v" * 300 + " " + "v" * 301 + " " + rows[0][1])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == brute_substrings(rows) and got[1][1] == 0


def test_hot_windows_and_copies(spark):
    """One passage in all of many documents, and one text copied over and over, in tasks of many chunks and few remembered keys."""
    rnd = random.Random(3)
    prose = lambda n: " ".join(rnd.choice("abcdefghij") * rnd.randrange(1, 4) + str(rnd.randrange(50)) for _ in range(n))
    passage, copied = prose(45), prose(300)
    rows = [(i, copied if i % 3 == 0 else prose(30) + " " + passage + " " + prose(rnd.randrange(1, 40))) for i in range(900)]
    for order in (rows, rows[::-1]):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.cleaned(spark.createDataFrame(order, "doc_id long, text string").coalesce(2)).collect()}
        assert got == brute_substrings(rows)


def test_automaton(docs, none):
    plain = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in bpe_automaton.encoded(docs, BYTE, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in DOCS:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids, got[i].ids_sha256, got[i].decoded, got[i].decoded_sha256) == (len(ids), ids, sha(",".join(map(str, ids))), back, sha(back))
    assert bpe_automaton.encoded(none, BYTE, public_tokenizers.PATTERN).count() == 0


def test_automaton_against_merging_pair_by_pair():
    rnd = random.Random(8)
    for _ in range(60):
        labels, merges = {0: b"a", 1: b"b", 2: b"c"}, []
        for _ in range(rnd.randrange(1, 14)):
            u, v = rnd.choice(list(labels)), rnd.choice(list(labels))
            if labels[u] + labels[v] not in labels.values():
                merges.append((u, v, len(labels)))
                labels[len(labels)] = labels[u] + labels[v]
        own = bpe_automaton.Automaton([0, 1, 2], labels, merges, most_states=rnd.choice([3, 10, 1000]))
        for _ in range(60):
            word = [rnd.randrange(3) for _ in range(rnd.randrange(1, 12))]
            ids, rank = list(word), {(u, v): (k, w) for k, (u, v, w) in enumerate(merges)}
            while pairs := [(rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]:
                (_, w), k = min(pairs)
                ids[k : k + 2] = [w]
            assert own.encode(b"".join(labels[x] for x in word)) == ids


def test_token_files(docs, none):
    plain, at = Tokenizer.from_file(BYTE), 0
    files = token_files.write_token_files(docs, BYTE, segment_ids=2000)
    assert files.count() > 3
    got = sorted(map(tuple, token_files.read_token_files(files).collect()))
    for (i, t), row in zip(DOCS, got, strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert row == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(none, BYTE)).count() == 0


def test_patched_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        for high in (1, 50, 50_000, 4_000_000_000):
            x = rng.integers(0, high, n).astype(np.uint32)
            x[rng.random(n) < 0.02] = 4_294_967_295
            image = token_files.encode_segment(x, [n])
            assert (token_files.decode_segment(image)[0] == x).all()
            if n > 600:
                assert (token_files.decode_segment(image, 1, 3)[0] == x[256:768]).all()
    assert len(token_files.encode_segment(rng.integers(0, 256, 5000).astype(np.uint32), [5000])) < 5800
    with pytest.raises(ValueError, match="not a segment"):
        token_files.decode_segment(b"\0" * 64)


def test_packing(docs, none):
    plain = Tokenizer.from_file(WORD)
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in DOCS}
    rows = packing.packed(docs, WORD, group_tokens=9000).collect()
    seen, sequences = {i: [] for i in ids}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += range(r.start, r.start + r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(v) == list(range(len(ids[i]))) for i, v in seen.items())
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total == 2048 or total < 2048 and total & (total - 1) == 0
    assert packing.packed(none, WORD).count() == 0


def test_packing_balances_cost():
    rng = np.random.default_rng(2)
    pieces, room, cost = packing.pack(np.concatenate([rng.integers(5, 900, 800), [5000]]))
    full = cost[room == 2048]
    assert np.median(full) * 3 > full[2:].max() and sum(p[2] for p in pieces) == room.sum()


def test_packing_assignment():
    """Each piece against a plain search for the sequence of least cost that has room, documents in descending order."""
    rnd = random.Random(7)
    for size in (8, 64):
        lengths = [rnd.randrange(1, 3 * size) for _ in range(60)] + [size, size, 1]
        pieces, room, cost = packing.pack(np.array(lengths, np.int64), size, 1.0, 1.0 / size)
        left, spent, got = room.tolist(), [0.0] * len(room), {(d, a): (n, s, o) for d, a, n, s, o in pieces}
        expected, nth = {}, 0
        for d, n in enumerate(lengths):
            for a in range(0, n // size * size, size):
                expected[d, a] = (size, nth, 0)
                left[nth], spent[nth], nth = 0, size + size * size / size, nth + 1
        for d in sorted(range(len(lengths)), key=lambda d: -(lengths[d] % size)):
            a = lengths[d] // size * size
            while a < lengths[d]:
                want = lengths[d] - a
                fit = [s for s in range(nth, len(left)) if left[s] >= want]
                s = min(fit, key=lambda s: spent[s]) if fit else max(range(nth, len(left)), key=lambda s: left[s])
                n = min(want, left[s])
                expected[d, a] = (n, s, int(room[s]) - left[s])
                left[s], spent[s], a = left[s] - n, spent[s] + n + n * n / size, a + n
        assert got == expected and not any(left) and np.allclose(cost, spent)


def test_chat_format(spark):
    rnd = random.Random(6)
    bits = ["</s>", "[INST]", "[/INST]", "\\", "[GEN]", "[/GEN]", "[ROLE]", "a", "\n", "<", "s>", " "]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool[/ROLE]", None]), None if rnd.random() < 0.1 else "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 9))), 9) for c in range(40) for t in range(rnd.randrange(1, 5))]
    rows += [(50, 0, "user", "x", 1), (50, 0, "user", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, messages int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(df)).collect()}
    turns = {}
    for c, t, r, x, _ in sorted(rows, key=lambda v: (v[0], v[1], v[2] or "user", v[3] or "")):
        turns.setdefault(c, []).append((r or "user", x or ""))
    for c, said in turns.items():
        loss = "".join(x for r, x in said if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)), len(loss), sha(loss))
    assert chat_format.formatted(df.limit(0)).count() == 0


def test_template_language():
    run = lambda source, **v: chat_format.compile_template(source)(v)[0]
    assert run("{% for x in xs %}{{ loop.index }}{{ x.n | upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"n": "a"}, {"n": "b"}]) == "1A,2B"
    assert run("a {%- if 1 + 1 == 2 and n -%} b {%- elif x -%} c {%- else -%} d {%- endif %}", n=0, x=1) == "ac"
    assert run("{% set y = 2 * 3 %}{{ y ~ 'z' }}{# no #}{{ 'u' in 'utter' }}{{ m['k'][0] }}", m={"k": [7]}) == "6zTrue7"
    tree = chat_format.fold(chat_format.parse("{{ 1 + 2 }}b{% if 2 > 1 %}c{% else %}{{ x }}{% endif %}"))
    assert tree == (chat_format.Output(chat_format.Const("3bc")),)
    assert chat_format.compile_template("{% generation %}{{ x }}{% endgeneration %}!")({"x": "ab"}) == ("ab!", [(0, 2)])
    for bad in ("{{ x.__class__ }}", "{{ f(1) }}", "{% for x in y %}", "{{ 'a' | nothing }}", "{{ 1 + }}", "{% import os %}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compile_template(bad)({"x": 1, "f": len, "y": []})


def test_quality_rules(docs, none):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, t in DOCS:
        t = t or ""
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = len({p for ks in at.values() if len(ks) > 1 for k in ks for p in (k, k + 1, k + 2)})
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat)
        assert r.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w)) and (not r.kept or not r.base_failed)
    assert quality_rules.judged(none).count() == 0
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].kept)


def plain_estimate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Center and inverse factor of the covariance of least determinant, by concentration steps from both starts until none falls."""
    steps = quality_rules.STEPS
    ends = []
    middle, q = np.median(x, axis=0), np.quantile(x, [0.25, 0.75], axis=0)
    for spread in ((q[1] - q[0]) / 1.349, np.median(np.abs(x - middle), axis=0) * 1.4826):
        center, factor, least = middle, np.diag(1 / np.maximum(spread, steps)), np.inf
        while True:
            d = (((x - center) @ factor.T) ** 2).sum(axis=1)
            bins = np.minimum(np.floor(np.log2(d + 1) * 64), 64 * 60)
            part = x[bins <= np.quantile(bins, quality_rules.SUBSET)]
            lower = np.linalg.cholesky(np.cov(part.T, bias=True).reshape(5, 5) * quality_rules.CONSISTENCY + np.eye(5) * steps**2)
            root = np.prod(np.diag(lower))
            if root < least:
                end = (root, part.mean(axis=0), np.linalg.inv(lower))
            if not root < least * (1 - quality_rules.LEAST_FALL):
                break
            least, center, factor = end
        ends.append(end)
    return min(ends, key=lambda e: e[0])[1:]


def test_covariance_estimates(spark):
    """The estimate against plain steps in numpy, with a third of outliers that it must not follow."""
    rng = np.random.default_rng(3)
    x = np.rint(rng.multivariate_normal([300, 200, 100, 50, 40], np.diag([900, 400, 400, 100, 100]) + 80, 400)).astype(int).clip(0)
    x[:133] = x[:133] // 4 + 2000
    rows = [("en", "s", *map(int, v)) for v in x]
    _, now, n = quality_rules.estimates(spark.createDataFrame(rows, "__lang string, __source string, x0 long, x1 long, x2 long, x3 long, x4 long"))
    e = now.first()
    w = np.array([[e[f"w{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    m = np.array([e[f"m{i}"] for i in range(5)])
    center, mine = plain_estimate(x)
    assert n == 1 and np.allclose(m, center) and np.allclose(w, mine)
    far = ((((x - m) @ w.T) ** 2).sum(axis=1)) > quality_rules.CUTOFF
    assert far[:133].all() and far[133:].mean() < 0.02


def test_quality_rules_verdicts(spark):
    """kept, against counts, groups, estimates and distances in plain Python; the name <null> is no null."""
    rnd, rows = random.Random(12), []
    word = lambda: "".join(rnd.choice("aeioustrn") for _ in range(rnd.randrange(1, 9)))
    for i in range(420):
        w = [word() for _ in range(rnd.randrange(30, 200))]
        if i % 9 == 0:
            w = [x + "#$%" * 3 for x in w]
        elif i % 11 == 0:
            w = w[:30] * 3
        rows.append((i, " ".join(w).replace(" a ", "\nline\n"), ["en", None, "<null>"][i % 3], "s" if i % 5 else None))
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    vectors, groups = {}, {}
    for i, t, lang, source in rows:
        r = got[i]
        if not r.base_failed:
            lines = [x for x in t.split("\n") if WORDS.search(x)]
            values = (np.log1p(r.n_words), r.word_chars / r.n_words, r.n_symbols / max(r.word_chars, 1), r.n_dup_lines / max(len(lines), 1), r.n_repeat_words / r.n_words)
            vectors[i] = [min(int(np.floor(v * (quality_rules.STEPS / f) + 0.5)), quality_rules.MOST) for v, f in zip(values, quality_rules.FLOORS.values())]
            groups.setdefault((lang, source), []).append(i)
    pooled = {}
    for (lang, source), members in groups.items():
        pooled.setdefault((lang, source if len(members) >= quality_rules.LEAST_GROUP else None), []).extend(members)
    rejected = 0
    for members in pooled.values():
        x = np.array([vectors[i] for i in members])
        center, factor = plain_estimate(x)
        for i, d in zip(members, (((x - center) @ factor.T) ** 2).sum(axis=1)):
            assert abs(got[i].distance2 - d) < 1e-6 * (1 + d) and got[i].kept == (d <= quality_rules.CUTOFF)
            rejected += not got[i].kept
    assert 30 < rejected < 200 and not any(r.kept for r in got.values() if r.base_failed)


def test_covariance_estimates_bear_many_outliers(spark):
    """A third of outliers in all statistics, and up to 45 % in one or two, are all told from the rest, and mask nobody."""
    x, planted = {}, {"third": (133, range(5)), "one": (160, [0]), "two": (180, [2, 4]), "last": (180, [4])}
    for g, (k, at) in planted.items():
        x[g] = np.rint(np.random.default_rng(3).multivariate_normal([300, 200, 100, 50, 40], np.diag([900, 400, 400, 100, 100]) + 80, 400)).astype(int).clip(0)
        x[g][:k, list(at)] = x[g][:k, list(at)] // 4 + 2000
    rows = [("en", g, *map(int, v)) for g, vs in x.items() for v in vs]
    groups, now, n = quality_rules.estimates(spark.createDataFrame(rows, "__lang string, __source string, x0 long, x1 long, x2 long, x3 long, x4 long"))
    found = {r["__source"]: r for r in groups.join(now, "g").collect()}
    assert n == len(found) == len(planted)
    for g, (k, _) in planted.items():
        w = np.array([[found[g][f"w{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        far = (((x[g] - [found[g][f"m{i}"] for i in range(5)]) @ w.T) ** 2).sum(axis=1) > quality_rules.CUTOFF
        assert far[:k].all() and far[k:].mean() < 0.02


def accuracy(rows, labels, least):
    both = [(r.predicted, labels[r.doc_id]) for r in rows if r.doc_id in labels and r.held_out]
    assert len(both) > 30 and sum(a == b for a, b in both) / len(both) >= least


def test_quality_model(spark, docs, none):
    path = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{path}/labels.parquet")
    rows = quality_model.op2_quality_model(spark, path).collect()
    accuracy(rows, {r.doc_id: r.quality for r in known.collect()}, 0.93)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert quality_model.scored(docs, known).count() == len(DOCS) and quality_model.scored(none, known).count() == 0
    assert {r.score for r in quality_model.scored(docs, known.limit(0)).collect()} == {0.5}


def test_class_prior_and_risk():
    rng = np.random.default_rng(7)
    good, bad = rng.normal(2, 1, (900, quality_model.N_FEATURES)), rng.normal(-2, 1, (900, quality_model.N_FEATURES))
    net, prior = quality_model.train(good[:300], np.concatenate([good[300:], bad[:257]]))
    assert abs(prior - 0.7) < 0.06
    assert (net.score(good) > 0.5).mean() > 0.95 and (net.score(bad) < 0.5).mean() > 0.95


def test_toxicity(spark, docs, none):
    path = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{path}/labels.parquet")
    rows = toxicity.op4_toxicity(spark, path).collect()
    accuracy(rows, {r.doc_id: r.toxic for r in known.collect()}, 0.9)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.scored(docs, known.limit(0)).count() == len(DOCS) and toxicity.scored(none, known).count() == 0


def test_recurrent_gradients():
    these = ["a b idiot c", "foo bar baz qux zed", "a foo c", "idiot bar"]
    w = toxicity.Words(these)
    net = toxicity.Network({0: (np.sort(w.keys)[:5], np.zeros(5)), 4: (np.unique(w.keys_of(4))[1:], np.zeros(len(np.unique(w.keys_of(4))) - 1))})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    start, length, _ = w.windows()
    y = np.array([1, 0, 0, 1.0])

    def loss() -> float:
        out = net.logits(net.looked_up(w)[0], w.index, start, length)
        return float(np.logaddexp(0, out).sum() - (out * y).sum())

    inputs, found = net.looked_up(w)
    out, kept = net.logits(inputs, w.index, start, length, keep=True)
    for name, g in net.slopes(inputs, found, kept, 0.5 * (1 + np.tanh(out / 2)) - y).items():
        for j in np.abs(g).ravel().argsort()[-3:]:
            v, e = net.p[name], 1e-3
            v.flat[j] += e
            up = loss()
            v.flat[j] -= 2 * e
            down = loss()
            v.flat[j] += e
            assert abs((up - down) / 2 / e - g.flat[j]) < 2e-3 * (1 + abs(g.flat[j])), name


def test_every_window_is_scored():
    w = toxicity.Words(["a " * n for n in (0, 1, 64, 65, 96, 97, 1000)])
    start, length, text = w.windows()
    for k, n in enumerate((0, 1, 64, 65, 96, 97, 1000)):
        covered = {p for s, m, t in zip(start, length, text) if t == k for p in range(s - w.begins[k], s - w.begins[k] + m)}
        assert covered == set(range(n))
