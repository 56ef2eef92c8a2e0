"""Quality, language, toxicity, neighbours, near-duplicates and the pipeline."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from edges import BASE, LONG, TEXTS, docs, with_repeats
from pyspark.sql import functions as F

import corpus_pipeline
from medialake.llm import langid, neardup, neighbours, quality, queries, texts, toxicity
from medialake.llm.tables import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
LOWER = {i: i + 32 for i in range(65, 91)}


def area(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    p = (y == 1).sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def labels(spark, column, folder=SMALL):
    return spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", column).toPandas()


# words and hashes

def test_words_and_hashes_of_slices():
    column = pa.array([*TEXTS, "a  b", None, "b a\x0bc"])
    found, of = [], {}
    for t in texts.slices(column, limit=4000):
        start, end, owner = t.words()
        raw = t.data.tobytes()
        for a, e, o, h in zip(start, end, owner, t.hashes(start, end)):
            w = raw[a:e]
            found.append((t.first + int(o), w.decode()))
            assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
    assert found == [(i, w) for i, x in enumerate(column.to_pylist()) for w in WORD.findall(x or "")]


# quality

def test_quality_held_out(spark):
    got = queries.op1_quality(spark, SMALL).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    m = got[got["held_out"]].merge(labels(spark, "quality"), on="doc_id")
    assert area(m["score"].to_numpy(), m["quality"].to_numpy()) > 0.9


def test_quality_edges(spark):
    few = spark.createDataFrame([(13, 1), (21, 0), (13, None), (99, 1), (None, 1)], "doc_id long, quality int")
    model = quality.learn(with_repeats(spark), few)
    got = quality.score(with_repeats(spark), model).collect()
    assert len(got) == len(TEXTS) + 5 and all(0 <= r["score"] <= 1 for r in got)
    none = quality.learn(docs(spark), few.where("false"))
    assert {r["score"] for r in quality.score(docs(spark), none).collect()} == {0.5}
    assert quality.score(docs(spark, []), quality.learn(docs(spark, []), few)).count() == 0


# language

def test_language_held_out(spark):
    got = queries.op2_language(spark, SMALL).toPandas()
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got[got["held_out"]].merge(truth, on="doc_id")
    assert (m["lang_pred"] == m["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(4)
    first = count = np.zeros(0, np.int64)
    sizes = [0, 1, 4, 6, 3]
    scores = rng.normal(0, 3, (sum(sizes), 3)).astype(np.float32)
    count = np.array(sizes)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    path = langid.viterbi(scores, first, count, 2.0)

    def value(p, s):
        return sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))

    for a, n in zip(first, count):
        s, p = scores[a : a + n], path[a : a + n]
        best = max((value(q, s) for q in itertools.product(range(3), repeat=int(n))), default=0)
        assert abs(value(p.tolist(), s) - best) < 1e-4


def test_viterbi_with_many_languages():
    scores = np.full((6, 170), -5.0, np.float32)
    scores[:3, 150] = scores[3:, 169] = 0.0
    assert langid.viterbi(scores, np.array([0]), np.array([6]), 6.0).tolist() == [150] * 3 + [169] * 3


def test_language_edges(spark):
    german = "der schnelle braune fuchs springt über den faulen hund und die kleinen vögel singen"
    train = docs(spark, [(i + 1, BASE) for i in range(9)]).where("lang is not null").union(docs(spark, [(1, german)] * 9).withColumn("lang", F.lit("de")))
    model = langid.learn(train)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, list(enumerate([*TEXTS, "the lazy dog jumps over the river and the birds sing der faule hund und die kleinen vögel singen über den braunen fuchs"]))), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 12)] == ["und"] * 4 and all(got[i]["score"] == 0 for i in (0, 1, 2, 12))
    assert got[3]["lang_pred"] == "en" and got[3]["score"] == 1.0
    mixed = got[len(TEXTS)]
    assert [s["lang"] for s in mixed["lang_spans"]] == ["en", "de"]
    assert mixed["text"][mixed["lang_spans"][1]["start"] :].startswith("der faule")
    assert langid.identify(docs(spark, []), model).count() == 0
    nothing = langid.learn(docs(spark, []))
    assert {r["lang_pred"] for r in langid.identify(with_repeats(spark), nothing).collect()} == {"und"}


FOREIGN = ["Все люди рождаются свободными и равными в своём достоинстве и правах", "มนุษย์ทั้งหลายเกิดมามีอิสระ และเสมอภาคกันในเกียรติศักดิ์และสิทธิ", "人人生而自由，在尊严和权利上一律平等。 他们赋有理性和良心", "ﺍﻟﻨﺎﺱ ﺃﺣﺮﺍﺭ ﻣﺘﺴﺎﻭﻳﻦ"]


def test_foreign_scripts_are_in_no_language(spark):
    rows = list(enumerate([*FOREIGN, BASE, "the quick brown fox jumps Все люди рождаются свободными и равными"]))
    model = langid.learn(docs(spark, [(i + 1, BASE) for i in range(9)]))
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, rows), model).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in range(len(FOREIGN))] == [("en", 0.0)] * len(FOREIGN)
    assert got[4]["score"] == 1.0 and got[5]["lang_pred"] == "en" and abs(got[5]["score"] - 5 / 11) < 1e-9
    train = docs(spark, [(i + 101, BASE) for i in range(9)])
    unlabelled = docs(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    left = corpus_pipeline.identify_languages(spark, train.union(unlabelled), SF).where("doc_id < 100").collect()
    assert {(r["doc_id"], r["lang"]) for r in left} == {(4, "en")}


def test_mixed_languages_are_kept(spark):
    own = {"en": BASE, "de": "der schnelle braune fuchs springt über den faulen hund während sieben kleine vögel singen und fliegen hoch am himmel", "es": "el rápido zorro marrón salta sobre el perro perezoso cerca de la orilla mientras siete pájaros pequeños cantan"}
    train = docs(spark, []).select("doc_id", "text", "lang")
    for k, (lang, text) in enumerate(own.items()):
        train = train.union(spark.createDataFrame([(100 + 10 * k + i, text, lang) for i in range(9)], train.schema))
    parts = [text.split()[:n] for text, n in zip(own.values(), (8, 7, 5))]
    rng = random.Random(7)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(40))
    rows = [(1, " ".join(sum(parts, [])), None), (2, noise, None), (3, BASE, None), (4, noise + " " + BASE, None)]
    frame = train.union(spark.createDataFrame(rows, train.schema))
    found = {r["doc_id"]: r for r in langid.identify(frame, langid.learn(frame)).where("doc_id < 100").collect()}
    assert len(found[1]["lang_spans"]) == 3 and found[1]["score"] < 0.5 and found[1]["learned"] == 1.0 and found[2]["learned"] < 0.1
    left = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_languages(spark, frame, SF).where("doc_id < 100").collect()}
    assert left == {1: "en", 3: "en"}


# toxicity

def test_toxicity_held_out(spark):
    got = queries.op4_toxicity(spark, LARGER).toPandas()
    m = got[got["held_out"]].merge(labels(spark, "toxic", LARGER), on="doc_id")
    assert got["score"].between(0, 1).all() and area(m["score"].to_numpy(), m["toxic"].to_numpy()) > 0.93
    assert (m["predicted"] == m["toxic"]).mean() > 0.96


def test_kernel_forgives_gaps_and_inserted_characters():
    marks = toxicity.Landmarks([b"scoundrel", b"dimwit"])
    names = [b"scoundrel", b"s.c.o.u.n.d.r.e.l", b"s c o u n d r e l", b"scoxundrel", b"5coundre1".replace(b"1", b"l"), b"dimwit", b"sconce", b"river"]
    ends = np.cumsum([len(n) for n in names])
    k = marks.kernel(np.frombuffer(b"".join(names), np.uint8), np.concatenate(([0], ends[:-1])), ends)
    assert np.allclose(k[[0, 1, 2, 4], 0], 1, atol=1e-5) and k[3, 0] > 0.6 and k[6, 0] < 0.45 and k[7].max() < 0.05 and abs(k[5, 1] - 1) < 1e-5


def test_insults_inside_longer_runs_are_near():
    reader = toxicity.Reader(toxicity.Landmarks([b"moron", b"idiot", b"dimwit", b"scoundrel"]))
    hidden = ["y o u a r e s u c h a m o r o n g e t l o s t", "they say total.moron.loser here", "a mxoxrxoxn there", "some m1o1r1o1n there", "m x o y r z o w n", "y.o.u.a.r.e.a.m.o.r.o.n.b.y.e", "whatatotalmoronyouare", "m*o*r*o*n!", "moron"]
    plain = ["the river runs by the old bank", "t h e r i v e r r u n s b y t h e b a n k", "well.known.river", "", "- - 7"]
    (t,) = texts.slices(pa.array([*hidden, *plain]))
    values, text, count = reader.sentences(t)
    top = np.zeros(len(count))
    np.maximum.at(top, text, values[:, 0])
    assert top[: len(hidden)].min() > 0.9 and top[len(hidden) :].max() == 0


def test_toxic_sentences_are_learned(spark):
    rng = random.Random(1)
    plain = [f"w{i}ab{i % 7}" for i in range(60)]
    rows, marks = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["scoundrel", "dimwit", "blockhead"])
        rows.append((i, " ".join(words) + ". " + " ".join(rng.choice(plain) for _ in range(9)) + "."))
        marks.append((i, int(bad)))
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"))
    tests = ["w1ab1 w2ab2 you dimwit w3ab3.", "w1ab1 s-c-o-u-n-d-r-e-l w2ab2", "w5ab5 blo.ckhead.", "w1ab1 w2ab2 w9ab2. w3ab3", None, "", LONG]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, list(enumerate(tests))), model).collect()}
    assert min(got[i] for i in (0, 1, 2)) > 0.5 > max(got[i] for i in (3, 4, 5, 6))


def test_spaced_and_interleaved_insults_are_toxic(spark):
    rng = random.Random(1)
    plain = [f"w{i}ab{i % 7}" for i in range(60)]
    rows = [(i, " ".join([*(rng.choice(plain) for _ in range(30)), *([rng.choice(["scoundrel", "dimwit", "blockhead"])] if i % 4 == 0 else [])]) + ".") for i in range(400)]
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    tests = ["w1ab1 y o u s u c h a d i m w i t g e t l o s t w2ab2", "w1ab1 dxixmxwxixt w2ab2", "w1ab1 total.blockhead.loser", "w1ab1 t h e r i v e r b a n k w2ab2"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, list(enumerate(tests))), model).collect()}
    assert min(got[i] for i in (0, 1, 2)) > 0.5 > got[3]


def test_toxicity_edges(spark):
    none = toxicity.learn(docs(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(with_repeats(spark), none).collect()
    assert len(got) == len(TEXTS) + 5 and {round(r["score"], 6) for r in got} == {0.5}
    assert toxicity.score(docs(spark, []), none).count() == 0


# neighbours

def test_recall_against_brute_force(spark):
    got = defaultdict(list)
    for r in queries.op3_neighbours(spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(table["embedding"]).astype(np.float64), table["vec_id"].to_numpy()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = neighbours.exact(x, x[ids == q][0])
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1])) and all(s[ids == v][0] == score for _, v, score in rows)
        hit += len({v for _, v, _ in rows} & set(want.tolist()))
        total += 20
    assert hit / total >= 0.9


def test_recall_with_unequal_lengths():
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (4096, 64))
    x *= (rng.lognormal(0, 0.5, 4096) / np.linalg.norm(x, axis=1))[:, None]
    ids = np.arange(4096)
    index = neighbours.Index(ids, x)
    found, hit = index.search(ids[:200], x[:200], 20), 0
    for q, (near, _) in enumerate(found):
        s = neighbours.exact(x, x[q])
        s[q] = -np.inf
        hit += len(set(near.tolist()) & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hit / 4000 >= 0.9


def test_recall_on_plain_gaussian_vectors():
    rng = np.random.default_rng(12)
    x, ids = rng.normal(0, 1, (4096, 64)), np.arange(4096)
    found, hit = neighbours.Index(ids, x).search(ids[:200], x[:200], 20), 0
    for q, (near, _) in enumerate(found):
        s = neighbours.exact(x, x[q])
        s[q] = -np.inf
        hit += len(set(near.tolist()) & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hit / 4000 >= 0.9


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e-310])
def test_components_of_any_finite_size(size):
    rng = np.random.default_rng(13)
    x, ids = rng.normal(0, 1, (50, 8)), np.arange(50)
    assert all(len(i) == 3 for i, _ in neighbours.Index(ids, x * size).search(ids[:5], x[:5] * size, 3))
    mixed = np.vstack([x * size, x])
    assert all(len(i) == 3 for i, _ in neighbours.Index(np.arange(100), mixed).search(ids[:5], mixed[:5], 3))


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "mine") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0)]
    assert neighbours.nearest(df.where("false"), df.where("false")).count() == 0


def test_blocks_do_not_change_ties(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (40, 8))
    rows = [(i, base[i % 40].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, many = (sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=9, block=b).collect()) for b in (4096, 50))
    assert [r[:3] for r in one if r[1] == 1] == [r[:3] for r in many if r[1] == 1]
    assert all(v == [i for i in range(q % 40, 400, 40) if i != q][:9] for q, v in ((q, [r[2] for r in one if r[0] == q]) for q in range(0, 400, 20)))


# near-duplicates

def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def by_pairs(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[1] and s[0] is not None], 2):
        if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
            k = len(a & b)
            if 100 * k >= percent * (len(a) + len(b) - k):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), None if i is None else root(i)) for i, s in sets}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_components_by_brute_force(spark, size, percent):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = by_pairs([tuple(r) for r in df.collect()], size, percent)
    got = neardup.near_duplicates(df, size, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_family_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(350):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    want = by_pairs(rows, 3, 85)
    got = neardup.near_duplicates(docs(spark, rows), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicate_edges(spark):
    got = neardup.near_duplicates(with_repeats(spark), 3, 85).collect()
    assert len(got) == len(TEXTS) + 5
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    want = by_pairs([(i + 10, t) for i, t in enumerate(TEXTS)], 3, 85)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in by.items()} == want
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    left = neardup.drop_duplicates(docs(spark), 3, 85)
    assert left.columns == docs(spark).columns and {r["doc_id"] for r in left.collect()} == {k for k, (_, c) in want.items() if k == c}


def test_odd_sketch_estimates():
    rng = random.Random(5)
    a = [f"t{i}" for i in range(2000)]
    for change in (10, 40, 80):
        b = list(a)
        for i in rng.sample(range(2000), change):
            b[i] = f"z{rng.random()}"
        (_, _, _, s), = [neardup.signatures(t, 3) for t in texts.slices(pa.array([" ".join(a), " ".join(b)]))]
        x, y = shingle_set(" ".join(a), 3), shingle_set(" ".join(b), 3)
        d = int(np.bitwise_count(s.view(np.uint64)[0] ^ s.view(np.uint64)[1]).sum())
        guess = 1 + neardup.BITS / (4 * neardup.SAMPLES) * np.log(1 - 2 * d / neardup.BITS)
        assert abs(guess - len(x & y) / len(x | y)) < neardup.MARGIN


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_threshold_pass_the_sketches(percent):
    n, b, miss = neardup.SAMPLES, neardup.BITS, 0.0
    for k in range(n + 1):  # samples that differ; each toggles two bits, and the number of odd ones is nearly normal
        p = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(1 - percent / 100) + (n - k) * math.log(percent / 100))
        mean = b / 2 * (1 - (1 - 2 / b) ** (2 * k))
        var = b / 4 + b * (b - 1) / 4 * (1 - 4 / b) ** (2 * k) - b * b / 4 * (1 - 2 / b) ** (4 * k)
        miss += p * math.erfc((neardup.most_differing(percent) + 0.5 - mean) / math.sqrt(2 * max(var, 1e-6))) / 2
    assert miss < 1e-5


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# pipeline

def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"]
    frame = with_repeats(spark)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, frame, SF)
        if name != "packing":
            assert out.columns == frame.columns, name
            assert step(spark, docs(spark, []), SF).count() == 0
        frame = out
    assert frame.count() >= 0


def test_pipeline_keeps_whole_results(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.identify_languages(spark, documents, SF)
    assert one.count() > 0.95 * documents.count()
    two = corpus_pipeline.drop_near_duplicates(spark, one, SF)
    kept = {k for k, (_, c) in by_pairs([(r["doc_id"], r["text"]) for r in one.collect()], 5, 80).items() if k == c}
    assert {r["doc_id"] for r in two.collect()} == kept
    last = corpus_pipeline.run(spark, SF)
    rows = last.collect()
    per = Counter()
    for r in rows:
        per[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in rows} <= kept and max(per.values()) <= 4096
