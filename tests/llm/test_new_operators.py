"""Ranked search, online packing and the conversation trie against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from medialake.llm import fptree, turntrie, windows
from medialake.llm.tokens import ByteIds, Store
from medialake.llm.turntrie import DoubleArray, dense

BPE = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def whole(path=BPE):
    return Tokenizer.from_file(path)


# --- token ids

@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", " a", "a ", "\n a", "a\n b", "a\t b  c", "<|endoftext|>", "x <|endoftext|> y", "don't  they've", "é è  ñ",
                                  "a\x1c b", "a  b", "a　 b", "日本 語", "z" * 300 + " y", "﻿ x", "1 2  3\n\n 4"])
def test_ids_of_odd_texts(text):
    assert ByteIds.of(BPE)([text]) == [np.array(whole().encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\t1.é日 \x1c", max_size=30), max_size=4))
def test_ids_are_those_of_whole_texts(texts):
    assert ByteIds.of(BPE)(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole().encode_batch(texts, add_special_tokens=False)]


def test_ids_of_every_code_point_and_of_random_words():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}{c} {c}b 1{c}  {c}'s" for c in points[::7]]
    rng = np.random.default_rng(8)
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), n)) for n in rng.integers(1, 14, 4000)]
    for k in range(0, len(texts), 20_000):
        assert ByteIds.of(BPE)(texts[k : k + 20_000]) == [np.array(e.ids, "<u4").tobytes() for e in whole().encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False)]


def test_store_drops_old_entries():
    store = Store(40)
    for k in range(0, 200, 10):
        keys = {*range(k, k + 10), *range(max(0, k - 5), k)}
        new = store.missing(keys)
        assert set(new) <= set(range(k, k + 10)) or k == 0
        store.young.update((x, str(x)) for x in new)
        assert keys <= store.young.keys() and len(store.young) + len(store.old) <= 60


# --- online packing

def check_packing(rows, texts, capacity):
    """Every id once, no gaps, sequences full but for powers of two."""
    ids = {k: (*whole().encode(t or "", add_special_tokens=False).ids, 0) for k, t in texts.items()}
    seen, places = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(seen) == set(texts)
    for k, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[k])
    sizes = []
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(s == capacity or s & (s - 1) == 0 for s in sizes) and max(sizes, default=0) <= capacity
    assert sum(s < capacity for s in sizes) < capacity.bit_length()
    return sizes


@pytest.mark.parametrize("partitions, fan", [(1, 64), (9, 2)])
def test_packing_places_every_id_once(spark, partitions, fan):
    texts = {i: " ".join(f"w{j * i % 97}" for j in range(i * 7 % 400)) for i in range(150)} | {1000: None, 1001: "", 1002: "long " * 5000}
    docs = spark.createDataFrame([(k, v, k) for k, v in texts.items()], "doc_id long, text string, offset long").repartition(partitions)
    out = windows.pack_online(docs, BPE, capacity=256, windows=4, fan=fan)
    assert out.columns.count("offset") == 1
    rows = [r.asDict() for r in out.collect()]
    check_packing(rows, texts, 256)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)


def test_packing_windows_are_bounded_and_best_fit():
    w = windows.Windows(capacity=10, most=2, first=0)
    for row, n in enumerate([6, 7, 4, 3]):
        w.put(row, 0, b"\0" * 4 * n, n)
    # 4 goes to the window with 6, 3 to the one with 7
    assert [(p[0], s, o) for p, s, o in w.take()] == [(0, 0, 0), (2, 0, 6), (1, 1, 0), (3, 1, 7)]
    for row, n in enumerate([6, 7, 9]):
        w.put(row, 0, b"\0" * 4 * n, n)
    # none fits: the fullest takes 3 of the 9, the others open a window
    assert [(p[0], p[1], len(p[2]) // 4) for p, _, _ in w.take()] == [(1, 0, 7), (2, 0, 3)]
    assert len(w.open) == 2


def test_packing_edges(spark):
    schema = "doc_id long, text string, ids string, `__task` int"
    assert windows.pack_online(spark.createDataFrame([], schema), BPE).count() == 0
    rows = windows.pack_online(spark.createDataFrame([(None, None, "x", 1), (5, "a b", "y", 2), (5, "a b", "y", 2)], schema), BPE).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows if r["start"] == 0) == [(0, 1), (5, 3), (5, 3)] or sum(r["length"] for r in rows) == 7
    assert sum(r["length"] for r in rows) == 7
    again = windows.pack_online(spark.createDataFrame([(5, "a b")], "doc_id long, text string"), BPE, keep_ids=False).collect()
    assert all(r["ids"] is None for r in again) and sum(r["length"] for r in again) == 3


# --- ranked search

def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_search(docs, items, k=10):
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(terms_of(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_search_is_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(60)] + ["Ñu", "日本", "x" * 40]
    p = 1 / np.arange(1, 64)
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 40), p=p / p.sum()))) for i in rng.permutation(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(80)] + [(2000, None), (2001, ""), (2002, "?!"), (None, docs[7][1]), (3, "t1 T1-t2")]
    items = [(i, " ".join(rng.choice(words, 6))) for i in range(25)] + [(90, None), (91, "..."), (None, "t1"), (92, "T5 t5 t5"), (92, "t7"), (93, "nowhere")]
    want = brute_search(docs, items)
    ask, all_docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for more in ({}, {"block": 7}, {"at_once": 60}):
        assert sorted((tuple(r) for r in fptree.rank(all_docs, ask, **more).collect()), key=str) == want


def test_search_edges(spark):
    docs, items = "doc_id long, text string, term string, rank int, n long", "item_id long, text string, score long"
    none = spark.createDataFrame([], docs)
    some = spark.createDataFrame([(1, "a b", "x", 0, 9)], docs)
    ask = spark.createDataFrame([(1, "a", 5)], items)
    assert fptree.rank(none, ask).count() == 0 and fptree.rank(some, spark.createDataFrame([], items)).count() == 0
    assert fptree.rank(spark.createDataFrame([(1, None, "x", 0, 9)], docs), ask).count() == 0
    two = spark.createDataFrame([(1, "a b", "x", 0, 9), (1, "a b", "x", 0, 9), (2, "c", "x", 0, 1)], docs)
    assert [(r["rank"], r["doc_id"]) for r in fptree.rank(two, ask).orderBy("rank").collect()] == [(1, 1), (2, 1)]


def tree_of(rng, n, n_terms):
    paths = [np.sort(rng.choice(n_terms, rng.integers(0, 12), replace=False)) for _ in range(n)]
    times = [rng.integers(1, 9, len(p)) for p in paths]
    return paths, times, fptree.Tree(paths, times, np.arange(n), rng.integers(10, 300, n), n_terms)


def test_tree_bounds_hold_for_every_vector():
    _, _, tree = tree_of(np.random.default_rng(1), 900, 40)
    covered = np.zeros(900, int)
    for k in range(len(tree.lo)):
        part = slice(tree.lo[k], tree.hi[k])
        assert (tree.table[part].max(0) == tree.most[k]).all() and tree.m[part].min() == tree.least[k]
        if tree.many[k]:
            own = range(tree.child[k], tree.child[k] + tree.many[k])
            assert [tree.lo[c] for c in own] == [tree.lo[k], *(tree.hi[c] for c in list(own)[:-1])] and tree.hi[own[-1]] == tree.hi[k]
        else:
            covered[part] += 1
    assert (covered == 1).all()


def test_branch_and_bound_scores_few_vectors():
    """A tree whose rare terms lie apart: an item of these terms needs a part of the vectors, with the same result."""
    rng = np.random.default_rng(2)
    group = rng.integers(0, 20, 2000)
    paths = [np.sort(np.unique([g % 4, *(4 + 10 * g + rng.integers(0, 10, 5))])) for g in group]
    tree = fptree.Tree(paths, [np.ones(len(p), int) for p in paths], np.arange(2000), np.full(2000, 100), 204)
    best = fptree.Best(10)
    scored = fptree.search(tree, np.array([4, 5, 6]), np.array([500, 500, 500]), best)
    every = (500 * fptree.part_of_score(tree.table[:, 4:7].astype(np.int64), tree.m[:, None])).sum(1)
    assert best.score.tolist() == sorted(every.tolist(), reverse=True)[:10] and scored < 500


def test_term_keys_tell_long_words_apart():
    """Words of two letters in Thue-Morse order, which polynomial hashes modulo 2^64 do not tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    a, b = ("".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits))
    data = np.frombuffer((a + b).encode(), np.uint8)
    keys = fptree.term_keys(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert keys[0] != keys[1]


# --- conversation trie

def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def below(p):
        own = (len(nodes[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        parts = [below(k) for k in kids[p]]
        leaves, saved = sum(x[0] for x in parts) or 1, own + sum(x[1] for x in parts)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(convs[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        below(())
    return sorted(out, key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], turn_key(x)))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def turn_key(x):
    return hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()


@pytest.mark.parametrize("shard, fan", [(turntrie.SHARD_TURNS, 64), (9, 2)])
def test_trie_is_brute_force(spark, shard, fan):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(300):
        for t in range(int(rng.integers(0, 7))):
            rows.append((c, t, ["user", "assistant", None][t % 3], [f"say {int(rng.integers(0, 3))} now", None, ""][0 if rng.random() < 0.9 else int(rng.integers(1, 3))]))
    rows += [(500 + i, t, "user", f"the same {t}") for i in range(60) for t in range(4)]
    rows += [(None, 0, "user", "nobody"), (7, None, "user", "before"), (7, 1, "user", "tie"), (7, 1, "user", "eit"), (803, 0, "user", "only")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = turntrie.trie(turntrie.shared_openings(turntrie.sequences(frame)), shard, fan)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rebuilt(rows))


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string, turns int, head string, depth int"
    assert turntrie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    alone = turntrie.conversation_trie(spark.createDataFrame([(5, 0, None, None, 1, "x", 2), (5, 0, None, None, 1, "x", 2)], schema)).orderBy("depth").collect()
    end = hashlib.sha256(b"5").hexdigest()
    assert [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_leaves"], r["ends_sha256"] == end) for r in alone] == [(5, 0, None, 1, False), (5, 1, 5, 1, False), (5, 2, 5, 1, True)]
    turnless = turntrie.trie(spark.createDataFrame([(9, []), (3, [])], "conv_id long, turns array<struct<d: binary, w: bigint>>")).collect()
    assert [tuple(r)[:7] for r in turnless] == [(3, 0, None, 2, 0, 1, 0)] and turnless[0]["ends_sha256"] == hashlib.sha256(b"3,9").hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.lists(st.integers(0, 40), max_size=6).map(tuple), min_size=1, max_size=60))
def test_double_array_gives_one_slot_a_prefix(found):
    order = sorted(found)
    size = np.array([len(s) for s in order])
    flat = np.array([c for s in order for c in s], np.int64)
    code, n = dense(flat)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    trie = DoubleArray(code, first, size)
    slots = {}
    for d, (on, at) in enumerate(trie.walk(code, first, size)):
        for i, s in zip(on.tolist(), at.tolist()):
            assert slots.setdefault(order[i][:d], s) == s
    assert len(set(slots.values())) == len(slots) == len({s[:d] for s in order for d in range(len(s) + 1)})
    assert all(trie.check[s] == (slots[p[:-1]] if p else -1) for p, s in slots.items())


# --- ids of the word tokenizer, whole texts at once

WORDS_BPE = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def word_ids():
    from medialake.llm.packing import TextIds

    return TextIds(WORDS_BPE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abstmdrevlL''' \t\n\x1c\x0019.,-<|>éÉßÀÿ×÷é日\xa0", max_size=30), max_size=6))
def test_word_ids_are_those_of_whole_texts(texts):
    import pyarrow as pa

    got = [x for _, some in word_ids()(pa.array(texts, pa.string())) for x in some]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in whole(WORDS_BPE).encode_batch(texts, add_special_tokens=False)]


def test_word_ids_of_special_tokens_nulls_and_random_words():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = ["<|endoftext|>", "x <|startoftext|>y", "'S 'RE'Ll", "''s", "s'", None, "", "é́", "日本 'd"]
    texts += [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzßéñüç"), n)) for n in rng.integers(1, 14, 30)) for _ in range(300)]
    got = [x for _, some in word_ids()(pa.array(texts)) for x in some]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in whole(WORDS_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
