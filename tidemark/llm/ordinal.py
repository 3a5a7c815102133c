"""A quality classifier for graded ratings: cumulative-link regression on hashed text.

All grades share one weight vector over hashed words and word shapes; ordered thresholds cut its
score into grades. It gives the expected grade and the probability of each grade or more, so a
selection can ask for either. It learns from all ratings: dealt into blocks, each block takes the
model through its documents and the blocks' models are averaged after every epoch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import batches, dealt, labelled, learnt
from tidemark.storage import dropped

BUCKETS = 1 << 17
BLOCK = 4096  # rated documents of a block
EPOCHS = 12
RATE = 0.5
DECAY = 1e-5
KEEP_FROM = 0.4

_SHAPES = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"9")]


def features(text: str | None, known: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: log counts of words and word shapes, each part of length one."""
    word_ids, shape_ids = [], []
    for word in (text or "").encode("utf-8", "surrogatepass").split():
        pair = known.get(word)
        if pair is None:
            if len(known) > 1 << 19:
                known.clear()
            shape = word
            for pattern, letter in _SHAPES:
                shape = pattern.sub(letter, shape)
            known[word] = pair = (zlib.crc32(word.lower()) % BUCKETS, zlib.crc32(b"\0" + shape[:8]) % BUCKETS)
        word_ids.append(pair[0])
        shape_ids.append(pair[1])
    at, values = [], []
    for ids in (word_ids, shape_ids):
        own, counts = np.unique(np.array(ids, np.int64), return_counts=True)
        value = np.log1p(counts)
        at.append(own)
        values.append(value / max(np.sqrt((value ** 2).sum()), 1e-9))
    size = np.log1p(len(word_ids)) / 10
    return np.concatenate([*at, [0]]), np.concatenate([*values, [size]])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Ordinal:
    weight: np.ndarray
    cuts: np.ndarray  # ascending; a grade is the number of cuts below the noisy score

    def at_least(self, score: float) -> np.ndarray:
        """Probability of each grade or more, from grade 1 on."""
        return _sigmoid(score - self.cuts)


def fitted(texts: list[str], grades: np.ndarray, n_grades: int, seed: int = 42) -> Ordinal:
    """Maximum likelihood by stochastic gradients, for texts that fit in memory."""
    rng = np.random.default_rng(seed)
    known: dict = {}
    rows = [features(t, known) for t in texts]
    grades = np.asarray(grades, int)
    flat = _beginning(np.array([(grades == g).sum() for g in range(n_grades)]))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        _pass(flat, [rows[i] for i in order], grades[order], RATE / (1 + epoch))
        flat[:BUCKETS] *= 1 - DECAY * len(rows)
    return _shaped(flat)


def _beginning(counts: np.ndarray) -> np.ndarray:
    """Weights of zero, the first cut and the logarithms of the gaps behind it, from the documents of each grade."""
    above = np.cumsum(counts[::-1])[::-1]
    share = np.clip(above[1:] / above[0] if above[0] else np.full(len(counts) - 1, 0.5), 0.01, 0.99)
    cuts = -np.log(share / (1 - share))
    return np.concatenate([np.zeros(BUCKETS), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])


def _shaped(flat: np.ndarray) -> Ordinal:
    return Ordinal(flat[:BUCKETS], flat[BUCKETS] + np.r_[0, np.cumsum(np.exp(flat[BUCKETS + 1:]))])


def _pass(flat: np.ndarray, rows: Iterable[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rate: float) -> None:
    """Gradient steps through rows, in place; thresholds stay ordered as sums of exponentials."""
    weight, gaps, first = flat[:BUCKETS], flat[BUCKETS + 1:], flat[BUCKETS]
    for (at, value), g in zip(rows, grades):
        cuts = first + np.r_[0, np.cumsum(np.exp(gaps))]
        above = _sigmoid(weight[at] @ value - cuts)
        up, down = np.r_[1, above], np.r_[above, 0]
        p = max(up[g] - down[g], 1e-9)
        slope = above * (1 - above)
        # d log p / d score and d log p / d cut, the grade's two cuts alone have a part in it.
        by_cut = np.zeros(len(cuts))
        if g > 0:
            by_cut[g - 1] -= slope[g - 1] / p
        if g < len(cuts):
            by_cut[g] += slope[g] / p
        by_score = -by_cut.sum()
        np.add.at(weight, at, rate * by_score * value)
        first += 0.02 * rate * by_cut.sum()
        gaps += 0.02 * rate * np.exp(gaps) * np.array([by_cut[k + 1:].sum() for k in range(len(gaps))])
    flat[BUCKETS] = first


def trained(docs: DataFrame, ratings: DataFrame, n_grades: int, seed: int = 42) -> Ordinal:
    """Fitted on all documents of ``ratings`` (doc_id, grade from 0). What is gathered is of fixed size."""
    def make():
        known: dict = {}

        def run(doc_ids, grades, texts):
            for doc_id, grade, text in zip(doc_ids, grades, texts):
                at, value = features(text, known)
                yield doc_id, grade, at.astype(np.int32), value
        return run

    rows = labelled(docs, ratings.where("grade is not null"), "grade")
    rows = batches(rows.select("doc_id", F.col("grade").cast("int"), "text"), make, "doc_id bigint, grade int, at array<int>, value array<double>")
    lessons, n = dealt(rows.withColumn("key", F.xxhash64("doc_id")), BLOCK, "ratings")
    counts = {r["grade"]: r["count"] for r in lessons.groupBy("grade").count().collect()}
    flat = _beginning(np.array([counts.get(g, 0) for g in range(n_grades)]))
    if n:
        for epoch in range(EPOCHS):
            flat = learnt(lessons, flat[:, None], _epoch(RATE / (1 + epoch), (seed, epoch)))[:, 0]
            flat[:BUCKETS] *= 1 - DECAY * n / -(-n // BLOCK)
    dropped(lessons)
    return _shaped(flat)


def _epoch(rate: float, seed: tuple[int, ...]):
    """Gradient steps through a block's documents, in a new order within each batch."""
    def learn(flat: np.ndarray, block: int, parts: Iterable[pa.RecordBatch]) -> int:
        rng, n = np.random.default_rng((*seed, block)), 0
        for part in parts:
            at, value, grades = part.column("at"), part.column("value"), part.column("grade").to_numpy()
            ends, places, values = at.offsets.to_numpy(), at.values.to_numpy(), value.values.to_numpy()
            begin = value.offsets.to_numpy() - ends  # the two lists are of equal lengths, but may begin at different places
            order = rng.permutation(len(grades))
            rows = ((places[ends[i]:ends[i + 1]], values[ends[i] + begin[i]:ends[i + 1] + begin[i]]) for i in order)
            _pass(flat[:, 0], rows, grades[order], rate)
            n += len(grades)
        return n
    return learn


def graded(docs: DataFrame, model: Ordinal, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, expected_grade, p_top, kept) of every whole text.

    ``kept`` if the best grade has at least the probability ``keep_from``. Null and empty texts
    have the grade that the thresholds alone give. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def make():
        known: dict = {}

        def run(doc_ids, texts):
            own = shared.value
            for doc_id, text in zip(doc_ids, texts):
                at, value = features(text, known)
                tail = own.at_least(float(own.weight[at] @ value))
                yield doc_id, float(tail.sum()), float(tail[-1]), bool(tail[-1] >= keep_from)
        return run
    return batches(docs.select("doc_id", "text"), make, "doc_id bigint, expected_grade double, p_top double, kept boolean")


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings from 0 to 2 from two judgements: one point for quality, one for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
