"""Search, decontamination and whitening against brute force, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F
from tests.conftest import SMALL
from tidemark.llm import best_position, whitening, winnowing

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, span string, words string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


@pytest.fixture(scope="module")
def odd_items(spark):
    """Null and repeated ids, null, empty, short and very long texts, repeated rows, and columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "many words here"), (4, "the same words again the same words again the same words"), (None, "two words"),
            (5, "ONE"), (5, "the same words again the same words again the same words"), (6, "x" * 50_000), (7, "日本語 text"),
            (8, "many words here " * 5_000), (4, "the same words again the same words again the same words")]
    return spark.createDataFrame([(*r, "d", "s", "w") for r in rows], ITEMS)


# Decontamination

def naive_overlap(text, items):
    """n_words, hit words and ids of the items, by comparing all spans."""
    own, hit, ids = words_of(text), set(), set()
    for item_id, item in items:
        theirs = words_of(item)
        n = min(len(theirs), winnowing.SPAN)
        spans = {tuple(theirs[i:i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i:i + n]) in spans:
                hit.update(range(i, i + n))
                ids.add(item_id)
    return len(own), hit, sorted(str(i) for i in ids - {None})


def check_overlaps(docs, items):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    named = [(r["item_id"], r["text"]) for r in items.collect()]
    want = sorted((str(d), n, sorted(hit), ids) for d, t in texts for n, hit, ids in [naive_overlap(t, named)])
    rows = winnowing.judged(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], [i for s in r["hit"] for i in range(s["begin"], s["end"])], r["items"]) for r in rows) == want
    assert all(r["n_hit"] == sum(s["end"] - s["begin"] for s in r["hit"]) for r in rows)


@pytest.mark.parametrize("letters, block", [(2, 1 << 20), (4, 1 << 20), (4, 40)])
def test_no_shared_span_is_missed(spark, monkeypatch, letters, block):
    monkeypatch.setattr(winnowing, "BLOCK_GRAMS", block)
    rng = random.Random(letters)
    make = lambda n: [rng.choice("abcd"[:letters]) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([1, 2, 6, 9, 10, 11, 14, 30])) if letters == 4 else make(rng.choice([10, 13, 25])))) for i in range(25)]
    docs = []
    for i in range(60):
        text = make(rng.randint(0, 60))
        theirs = rng.choice(items)[1].split()
        at, begin = rng.randint(0, len(text)), rng.randint(0, max(len(theirs) - 10, 0))
        text[at:at] = theirs[begin:begin + rng.randint(8, 14)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text).upper() if i % 2 else " ".join(text)))
    check_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))


def test_shared_spans_of_odd_tables(odd_documents, no_documents, odd_items):
    check_overlaps(odd_documents, odd_items)
    assert winnowing.judged(no_documents, odd_items).collect() == []
    assert {(r["n_hit"], tuple(r["items"])) for r in winnowing.judged(odd_documents, odd_items.where("false")).collect()} == {(0, ())}
    kept = winnowing.without_leaks(odd_documents.withColumn("_digest", F.lit(1)), odd_items)
    clean = [r["text"] for r in odd_documents.collect() if not naive_overlap(r["text"], [(r["item_id"], r["text"]) for r in odd_items.collect()])[1]]
    assert sorted(map(str, (r["text"] for r in kept.collect()))) == sorted(map(str, clean)) and "_digest" in kept.columns
    row = winnowing.digests(odd_documents.where("doc_id = 0"), odd_items).first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest() and row["contaminated"] is False


def test_least_hashes_are_few(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    kept = spark.createDataFrame([(text,)], "t string").select(F.size(winnowing.fingerprints(winnowing.words(F.col("t")), winnowing.SPAN))).first()[0]
    assert 5000 * 0.25 < kept < 5000 * 0.32


# Ranked search

def naive_ranks(docs, items, top):
    found = [(d, TERM.findall(lowered(t))) for d, t in docs]
    n, total = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    held = [Counter(w) for _, w in found]
    frequency = Counter(t for c in held for t in c)
    out = []
    for item_id, text in set(items):
        scores = []
        for (doc_id, terms), counts in zip(found, held):
            score = 0
            for t in TERM.findall(lowered(text)):
                if counts[t]:
                    m = 75 + 25 * len(terms) * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * frequency[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank + 1, s[2], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings", [200, 1 << 21])
def test_ranks_with_many_ties(spark, monkeypatch, postings):
    monkeypatch.setattr(best_position, "POSTINGS", postings)
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(40)]
    words = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=n))
    docs = [(i, words(rng.choice([0, 1, 5, 5, 20, 80]))) for i in range(300)]
    docs += docs[:40] + [(1000 + i, docs[i][1]) for i in range(100)] + [(None, "t3 t4 t5"), (None, None)]
    items = [(i, words(rng.choice([1, 3, 12]))) for i in range(20)] + [(5, "T3, t4; t3"), (99, None), (98, "unknown terms"), (5, "T3, t4; t3")]
    got = best_position.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == naive_ranks(docs, items, 7)


def test_items_in_blocks(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    monkeypatch.setattr(best_position, "BLOCK_CHARS", 3000)
    rows = [tuple(r) for r in best_position.ranked(docs, items).collect()]
    assert sorted(rows, key=str) == naive_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 20)


def test_best_positions_stop_early():
    rng = np.random.default_rng(4)
    n, lists = 50_000, 4
    term, doc = np.repeat(np.arange(lists), n), np.tile(np.arange(n), lists)
    impact = rng.zipf(1.6, n * lists).clip(1, 10**6)
    shard = best_position.Shard(term, doc, impact, lists)
    query = [(t, 1 + t) for t in range(lists)]
    docs, scores, looked_up = shard.best(query, 20, 0)
    total = sum(q * impact[t * n:(t + 1) * n] for t, q in query)
    least = np.sort(total)[-20]
    assert looked_up < n // 20
    assert set(docs.tolist()) == set(np.flatnonzero(total >= least).tolist()) and (total[docs] == scores).all()


def test_ranks_of_odd_tables(odd_documents, no_documents, odd_items):
    got = best_position.ranked(odd_documents, odd_items)
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == naive_ranks(docs, [(r["item_id"], r["text"]) for r in odd_items.collect()], 20)
    assert best_position.ranked(no_documents, odd_items).collect() == [] == best_position.ranked(odd_documents, odd_items.where("false")).collect()


# Whitening

def test_roots_of_the_secular_equation():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 20, 64):
        for _ in range(20):
            poles = np.sort(rng.choice([rng.random(size), rng.random(size) ** 12, np.arange(size) + rng.random(size) * 1e-9])) if size > 1 else rng.random(1)
            poles = np.sort(poles) + np.arange(size) * 1e-10
            share = rng.standard_normal(size) * 10.0 ** rng.integers(-3, 2, size)
            found, gap = whitening.roots(poles, share**2)
            assert np.allclose(found, np.linalg.eigvalsh(np.diag(poles) + np.outer(share, share)), rtol=1e-12, atol=1e-12 * (poles[-1] + share @ share))
            assert (np.diff(found) > 0).all() and (found > poles).all() and np.allclose(poles - found[:, None], gap, atol=1e-9)


def test_updates_and_joins_keep_the_scatter_matrix():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.standard_normal((300, 12)) * 40 * np.linspace(0, 1, 12)).astype(np.int64)
    rows[:, 5] = rows[:, 4]
    parts = []
    for chunk in np.split(rows, [3, 60, 61, 200]):
        s = whitening.Spectrum.empty(12)
        for row in np.concatenate([chunk, chunk[:2]]):
            s.add(row)
        parts.append((np.concatenate([chunk, chunk[:2]]), s))
    whole, seen = parts[0][1], parts[0][0]
    for more, s in parts[1:]:
        whole.join(s)
        seen = np.concatenate([seen, more])
    centred = seen - seen.mean(0)
    assert whole.n == len(seen) and (whole.sums == seen.sum(0)).all()
    assert np.allclose(whole.vectors.T @ whole.vectors, np.eye(12), atol=1e-12)
    assert np.allclose(whole.vectors * whole.values @ whole.vectors.T, centred.T @ centred, atol=1e-9 * np.trace(centred.T @ centred))


def check_whitened(rows, vectors, components=4):
    fit = np.unique(vectors, axis=0)
    n, sums = len(fit), fit.sum(0)
    covariance = (fit - fit.mean(0)).T @ (fit - fit.mean(0)) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    got = {}
    for r in rows:
        got.setdefault(r["component"], []).append(r)
    assert len(got) == min(components, vectors.shape[1])
    for c, own in got.items():
        own.sort(key=lambda r: r["vec_id"])
        assert len(own) == len(vectors)
        want = (vectors - sums / n) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        have = np.array([r["whitened"] for r in own])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert all(math.isclose(r["explained"], values[c - 1] / np.trace(covariance), rel_tol=1e-10) for r in own)
        assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in own)
        assert [r["deviation"] for r in own] == [int(((n * v - sums) ** 2).sum()) for v in vectors]


@pytest.mark.parametrize("per_task", [40, 2048])
def test_whitening_against_numpy(spark, monkeypatch, per_task):
    monkeypatch.setattr(whitening, "ROWS", per_task)
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    vectors = np.floor(np.array([r["embedding"] for r in frame.orderBy("vec_id").collect()], float) * 256).astype(np.int64)
    check_whitened(whitening.whitened(frame, "vec_id", "embedding").collect(), vectors)


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((50, 3)).round(2)
    vectors[10:30] = vectors[3]
    rows = [(i, v.tolist(), "c", 7) for i, v in enumerate(vectors)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, component string, n int"
    frame = spark.createDataFrame(rows + [(*b, None, None) for b in bad], schema)
    check_whitened(whitening.whitened(frame, "vec_id", "embedding").collect(), np.floor(vectors * 256).astype(np.int64))
    assert whitening.whitened(frame.where("vec_id > 99"), "vec_id", "embedding").collect() == []
    alone = whitening.whitened(frame.where("vec_id between 12 and 20"), "vec_id", "embedding").collect()
    assert len(alone) == 27 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone} == {(1, 0, None, None, None)}
    uneven = spark.createDataFrame([(1, [1.0]), (None, [1.0, 2.0]), (1, []), (3, [0.5, 0.25])], "vec_id long, embedding array<double>")
    got = whitening.whitened(uneven, "vec_id", "embedding").collect()
    assert len(got) == 8 and all(r["n"] == 4 and r["identity_error"] < 1e-9 for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whitened(line, "vec_id", "embedding").collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got)
