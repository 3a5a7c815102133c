"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to rows of an embedding table; filters over one, two and three words slide over the
whole text, each keeps its largest response, and a linear layer turns these into a logit. Training
takes all labelled documents: dealt into blocks, each block takes the model through its documents
and the blocks' models are averaged after every epoch. Embeddings begin with how much more often a
word is found in toxic documents than chance would have it, so that the largest responses point at
such words from the start; words in fewer than three documents stay at zero and can't be learnt by
heart. Thresholds are set for each language on documents kept back from training.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import SLICE, batches, dealt, labelled, learnt
from tidemark.storage import dropped

BUCKETS = 1 << 18
WIDTH = 8
FILTERS = 8
SPANS = (1, 2, 3)
BLOCK = 4096  # labelled documents of a block
LEARNT = 4800  # the lift of a word is that in so many documents, however many there are
EPOCHS = 5
RATE = 0.02
MIN_DOCUMENTS = 3
PRECISION = 0.95
PREDICTED_FROM = 0.3
STEPS = 1 << 14  # thresholds are whole parts of this
CHUNK = 1 << 15
STRIPPED = b".,;:!?\"'()[]{}|*#$%&<>-_=+/\\"


def words(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Buckets of a text's words, in lower case and without punctuation around them."""
    out = []
    for word in (text or "").lower().encode("utf-8", "surrogatepass").split():
        bucket = known.get(word)
        if bucket is None:
            if len(known) > 1 << 19:
                known.clear()
            known[word] = bucket = zlib.crc32(word.strip(STRIPPED)) % BUCKETS
        out.append(bucket)
    return np.array(out, np.int64)


@dataclass
class Classifier:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each span: (span, WIDTH, FILTERS)
    weight: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, ids: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Responses of all filters at each word; ``left`` counts the words up to the text's end."""
        rows = self.embedding[ids]
        out = []
        for kernel in self.filters:
            total = rows @ kernel[0]
            for j in range(1, len(kernel)):
                total[:-j] += (rows[j:] @ kernel[j]) * (left[:-j] > j)[:, None]
            out.append(total)
        return np.concatenate(out, 1)

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Largest response of each filter in each text, zeros for one without words."""
        out = np.zeros((len(texts), len(self.weight)), np.float32)
        sizes = np.array([len(t) for t in texts])
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        ids = np.concatenate([texts[i] for i in full])
        owner = np.repeat(full, sizes[full])
        left = np.repeat(np.cumsum(sizes[full]), sizes[full]) - np.arange(len(ids))
        out[full] = -np.inf
        reach = max(SPANS) - 1
        for a in range(0, len(ids), CHUNK):
            b = min(a + CHUNK, len(ids))
            found = self.responses(ids[a:b + reach], left[a:b + reach])[:b - a]
            own = owner[a:b]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            at = own[starts]
            out[at] = np.maximum(out[at], np.maximum.reduceat(found, starts))
        return out

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.thresholds[""])

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(texts) @ self.weight + self.bias, -30, 30).astype(np.float64)))


def _beginning(rng: np.random.Generator, df: np.ndarray, positive: np.ndarray, n: int, n_positive: float) -> Classifier:
    """The classifier before training, from the documents and toxic documents of each word and of all."""
    base = float(np.clip(n_positive / n if n else 0.0, 0.001, 0.999))
    part = min(1, LEARNT / max(n, 1))
    excess = np.tanh((positive - base * df) * part / np.sqrt(base * df * part + 1) / 4)
    embedding = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    embedding[:, 0] = excess
    embedding[df < MIN_DOCUMENTS] = 0
    filters = [rng.normal(0, 0.1, (n, WIDTH, FILTERS)).astype(np.float32) for n in SPANS]
    for kernel in filters:
        kernel[0, 0, :2] = 1
    weight = np.zeros(len(SPANS) * FILTERS, np.float32)
    for k in range(len(SPANS)):
        weight[k * FILTERS:k * FILTERS + 2] = 1
    return Classifier(embedding, filters, weight, float(np.log(base / (1 - base))))


def fitted(texts: list[str], labels: np.ndarray, langs: list[str | None], seed: int = 42) -> Classifier:
    """A classifier for 0/1 ``labels`` that fit in memory. Without both labels it gives everything the base rate."""
    rng = np.random.default_rng(seed)
    known: dict[bytes, int] = {}
    ids = [words(t, known) for t in texts]
    labels = np.asarray(labels, np.float32)
    held = np.arange(len(ids)) % 5 == 4
    learn = np.flatnonzero(~held)
    df, positive = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i in learn:
        own = np.unique(ids[i])
        df[own] += 1
        positive[own] += labels[i]
    model = _beginning(rng, df, positive, len(learn), labels[learn].sum())
    usual = df >= MIN_DOCUMENTS
    if 0 < labels[learn].sum() < len(learn):
        for _ in range(EPOCHS):
            order = rng.permutation(learn)
            for k in range(0, len(order), 32):
                _step(model, [ids[i] for i in order[k:k + 32]], labels[order[k:k + 32]], usual)
    kept = np.flatnonzero(held)
    model.thresholds = _thresholds(model.score([ids[i] for i in kept]), labels[kept], [langs[i] for i in kept]) if len(kept) else {"": 0.5}
    return model


def _step(model: Classifier, texts: list[np.ndarray], labels: np.ndarray, usual: np.ndarray) -> None:
    """One step of gradient descent; only the words at the largest responses have a gradient."""
    for ids, label in zip(texts, labels):
        if not len(ids):
            continue
        found = model.responses(ids, len(ids) - np.arange(len(ids)))
        at = found.argmax(0)
        top = found[at, np.arange(found.shape[1])]
        error = 1 / (1 + np.exp(-np.clip(float(top @ model.weight) + model.bias, -30, 30))) - label
        back = error * model.weight * RATE
        model.weight -= RATE * (error * top + 1e-4 * model.weight)
        model.bias -= RATE * error
        for s, kernel in enumerate(model.filters):
            cols = slice(s * FILTERS, (s + 1) * FILTERS)
            step, where = back[cols], at[cols]
            for j in range(len(kernel)):
                inside = where + j < len(ids)
                own = ids[np.minimum(where + j, len(ids) - 1)]
                rows = model.embedding[own]
                change = kernel[j].T * (step * inside * usual[own])[:, None]
                kernel[j] -= (rows * (step * inside)[:, None]).T
                np.subtract.at(model.embedding, own, change)


def _thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """For each language the least score from which on PRECISION holds; "" is for all others."""
    out = {}
    for lang in {"", *(x for x in langs if x)}:
        own = np.array([lang in ("", x) for x in langs])
        y, s = labels[own], scores[own]
        if y.sum() < 5:
            continue
        order = np.argsort(-s)
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= PRECISION)
        out[lang] = float(np.clip(s[order][good[-1]], PREDICTED_FROM, 0.9)) if len(good) else 0.9
    return {"": 0.5} | out


LESSON = "doc_id bigint, lang string, toxic int, words array<int>"


def _flat(model: Classifier) -> np.ndarray:
    """All parameters as rows of WIDTH (equal to FILTERS): embedding, filters, weight, bias."""
    last = np.zeros((1, WIDTH), np.float32)
    last[0, 0] = model.bias
    return np.concatenate([model.embedding, *(k.reshape(-1, WIDTH) for k in model.filters), model.weight.reshape(-1, WIDTH), last])


def _shaped(flat: np.ndarray) -> Classifier:
    """The classifier whose parameters, but for the bias, are views of ``flat``."""
    filters, at = [], BUCKETS
    for n in SPANS:
        filters.append(flat[at:at + n * WIDTH].reshape(n, WIDTH, FILTERS))
        at += n * WIDTH
    return Classifier(flat[:BUCKETS], filters, flat[at:-1].reshape(-1), float(flat[-1, 0]))


def _lessons(part: pa.RecordBatch) -> list[np.ndarray]:
    """Buckets of the words of each row."""
    words = part.column("words")
    ends, values = words.offsets.to_numpy(), words.values.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def trained(docs: DataFrame, labels: DataFrame, use: Column, seed: int = 42) -> Classifier:
    """A classifier from all labelled documents for which ``use`` holds; a fifth of them sets the thresholds alone.

    What is gathered is of fixed size: counts by word, changes by parameter, and a threshold for each language.
    """
    def make():
        known: dict[bytes, int] = {}

        def run(doc_ids, langs, marks, texts):
            for doc_id, lang, mark, text in zip(doc_ids, langs, marks, texts):
                yield doc_id, lang or "", mark, words(text, known).astype(np.int32)
        return run

    rows = labelled(docs, labels.where(F.col("toxic").isNotNull() & use), "toxic")
    rows = batches(rows.select("doc_id", "lang", F.col("toxic").cast("int"), "text"), make, LESSON)
    lessons, _ = dealt(rows.withColumn("key", F.xxhash64("doc_id")), BLOCK, "lessons")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 4
    learn = lessons.where(~held)
    df, positive, n, n_positive = _counts(learn)
    flat = _flat(_beginning(np.random.default_rng(seed), df, positive, n, n_positive))
    if 0 < n_positive < n:
        for epoch in range(EPOCHS):
            flat = learnt(learn, flat, _epoch(df >= MIN_DOCUMENTS, (seed, epoch)))
    model = _shaped(flat)
    model.thresholds = _thresholds_of(lessons.where(held), model)
    dropped(lessons)
    return model


def _counts(lessons: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents and toxic documents with each word, and of all."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, positive = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for part in parts:
            for own, mark in zip(_lessons(part), part.column("toxic").to_numpy()):
                own = np.r_[np.unique(own), BUCKETS]
                n[own] += 1
                positive[own] += mark
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(positive[at])], names=["at", "n", "positive"])

    found = lessons.mapInArrow(run, "at bigint, n bigint, positive bigint").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("positive").alias("positive")).toArrow()
    out = np.zeros((2, BUCKETS + 1), np.int64)
    out[:, found["at"].to_numpy()] = found["n"].to_numpy(), found["positive"].to_numpy()
    return out[0, :-1], out[1, :-1], int(out[0, -1]), int(out[1, -1])


def _epoch(usual: np.ndarray, seed: tuple[int, ...]):
    """Gradient descent through a block's documents, in a new order within each batch."""
    def learn(flat: np.ndarray, block: int, parts: Iterable[pa.RecordBatch]) -> int:
        rng, model, n = np.random.default_rng((*seed, block)), _shaped(flat), 0
        for part in parts:
            texts, marks = _lessons(part), part.column("toxic").to_numpy().astype(np.float32)
            order = rng.permutation(len(texts))
            _step(model, [texts[i] for i in order], marks[order], usual)
            n += len(texts)
        flat[-1, 0] = model.bias
        return n
    return learn


def _thresholds_of(lessons: DataFrame, model: Classifier) -> dict[str, float]:
    """As ``_thresholds``, from the counts of scores between neighbouring whole parts of STEPS.

    A threshold is such a part, so counts from it on are exact; of each language at most STEPS + 1 rows are ranked.
    """
    shared = lessons.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = _lessons(part)
            scores = np.concatenate([np.zeros(0), *(shared.value.score(texts[k:k + SLICE]) for k in range(0, len(texts), SLICE))])
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(np.floor(scores * STEPS).astype(np.int32)), part.column("toxic")],
                                             names=["lang", "score", "toxic"])

    counts = lessons.mapInArrow(run, "lang string, score int, toxic int").groupBy("lang", "score").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("positive"))
    every = counts.groupBy("score").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    both = counts.where("lang <> ''").unionByName(every.withColumn("lang", F.lit("")))
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    right = both.withColumn("right", F.sum("positive").over(down) / F.sum("n").over(down))
    found = right.groupBy("lang").agg(F.sum("positive").alias("positive"), F.min(F.when(F.col("right") >= PRECISION, F.col("score"))).alias("least"))
    out = {r["lang"]: 0.9 if r["least"] is None else min(max(r["least"] / STEPS, PREDICTED_FROM), 0.9)
           for r in found.where("positive >= 5").collect()}
    shared.destroy()
    return {"": 0.5} | out


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, lang, score, toxic): the score of every whole text, and whether it is at least the
    threshold of its language. Null and empty texts have the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def make():
        known: dict[bytes, int] = {}

        def run(doc_ids, langs, texts):
            own = shared.value
            scores = own.score([words(t, known) for t in texts])
            for doc_id, lang, score in zip(doc_ids, langs, scores.tolist()):
                yield doc_id, lang, score, score >= own.threshold(lang)
        return run
    return batches(docs.select("doc_id", "lang", "text"), make, "doc_id bigint, lang string, score double, toxic boolean")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score at or over the threshold of their language.

    Each row is judged by its own text, so of rows that share an id, or have none, only the toxic
    ones go. Labels of held-out ids are not learnt from.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, ~held_out(F.col("doc_id"))))  # of fixed size
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        known: dict[bytes, int] = {}

        def run(*columns):
            rows = dict(zip(names, columns))
            own = shared.value
            scores = own.score([words(t, known) for t in rows["text"]]).tolist()
            bad = [score >= own.threshold(lang) for score, lang in zip(scores, rows["lang"])]
            return [row for row, gone in zip(zip(*columns), bad) if not gone]
        return run
    return batches(docs, make, kind)
