"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions on top.

The patterns find the base spans. The network, trained in numpy from the labelled spans of all texts
(dealt into blocks of windows, whose networks are averaged after every round), reads windows that overlap; each is decoded by the CRF, and spans of neighbouring windows are reconciled over the
whole text: where windows disagree, the one in which a character lies deeper inside decides. What
the network is sure of and no base span touches is added.

All four kinds need a digit or an @, so the network reads the windows that have one: the rest of a
text can hold none of them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import batches, dealt, learnt
from tidemark.storage import dropped

# The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number of an address that failed from its first digit on fails from later ones too, so a match
# needs no digit before it; the same for the digits of a card.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW = 96
STRIDE = 64
HIDDEN = 12
STEPS = 800  # of each block, at least
ROUNDS = 10  # after which the blocks' networks are averaged, of equally many steps; a single block needs no more than one
BATCH = 32
RATE = 0.02
SURE = 0.95
SEED = 42
TAGS = 1 + 2 * len(KINDS)  # outside, then first and later characters of each kind

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) of the patterns, by start and then by kind as listed."""
    out, end = [], 0
    for m in EMAIL_TAIL.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append(("email", start, end))
    for m in IP.finditer(text):
        if all(int(x) <= 255 for x in (p.lstrip("0")[:4] or "0" for p in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is with letters in lower case, other letters and signs apart."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    return np.where(points < 128, points, 128 + (points >= 0x250))


@dataclass
class Tagger:
    """Parameters: for both directions (the first axis) a table of gate inputs by character and
    recurrent weights, the output layer, CRF transitions and the score of each tag at the start."""

    parts: dict[str, np.ndarray]

    def run(self, x: np.ndarray) -> list[np.ndarray]:
        """Gates, candidates, cells and states of both directions over x (windows, characters), each
        by (step, direction, window); the second direction steps from the end to the start."""
        table, recurrent = self.parts["table"], self.parts["recurrent"]
        inputs = np.stack([table[0][x.T], table[1][x.T[::-1]]], 1)
        h = c = np.zeros((2, len(x), HIDDEN), table.dtype)
        gates, candidates, cells, states = [], [], [], []
        for z in inputs:
            z = z + h @ recurrent
            gate = 1 / (1 + np.exp(-z[..., :3 * HIDDEN]))
            g = np.tanh(z[..., 3 * HIDDEN:])
            c = gate[..., HIDDEN:2 * HIDDEN] * c + gate[..., :HIDDEN] * g
            h = gate[..., 2 * HIDDEN:] * np.tanh(c)
            for kept, value in zip((gates, candidates, cells, states), (gate, g, c, h)):
                kept.append(value)
        return [np.stack(v) for v in (gates, candidates, cells, states)]

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Scores of tags (window, character, tag), the states behind them, and all of ``run``."""
        trace = self.run(x)
        both = np.concatenate([trace[3][:, 0], trace[3][::-1, 1]], 2).transpose(1, 0, 2)
        return both @ self.parts["out"] + self.parts["out_bias"], both, trace

    def marginals(self, scores: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of tags and, summed over places, of pairs of tags.

        Forward and backward weights are scaled to a sum of one at each place.
        """
        n, T, K = scores.shape
        trans = np.exp(self.parts["transitions"])
        weights = np.exp(scores - scores.max(2, keepdims=True))
        ahead, behind = np.ones_like(weights), np.ones_like(weights)
        first = weights[:, 0] * np.exp(self.parts["start"])
        ahead[:, 0] = first / first.sum(1, keepdims=True)
        live = np.arange(T)[None] < length[:, None]
        for t in range(1, T):
            step = (ahead[:, t - 1] @ trans) * weights[:, t]
            ahead[:, t] = np.where(live[:, t, None], step / step.sum(1, keepdims=True), ahead[:, t - 1])
        for t in range(T - 2, -1, -1):
            step = (weights[:, t + 1] * behind[:, t + 1]) @ trans.T
            behind[:, t] = np.where(live[:, t + 1, None], step / step.sum(1, keepdims=True), 1)
        both = ahead * behind
        before, after = ahead[:, :-1], weights[:, 1:] * behind[:, 1:]
        before = before * (live[:, 1:] / ((before @ trans) * after).sum(2))[:, :, None]
        pairs = trans * (before.reshape(-1, K).T @ after.reshape(-1, K))
        return both / both.sum(2, keepdims=True), pairs

    def decode(self, x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most likely tags of each window, and the probability of each tag chosen."""
        scores = self.emissions(x)[0]
        n, T, K = scores.shape
        trans = self.parts["transitions"]
        best, back = scores[:, 0] + self.parts["start"], np.zeros((n, T, K), np.int64)
        for t in range(1, T):
            way = best[:, :, None] + trans
            back[:, t] = np.where((t < length)[:, None], way.argmax(1), np.arange(K))
            best = np.where((t < length)[:, None], way.max(1) + scores[:, t], best)
        tags = np.zeros((n, T), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(T - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        sure = np.take_along_axis(self.marginals(scores, length)[0], tags[:, :, None], 2)[:, :, 0]
        return tags, sure


def _beginning(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda *shape, scale=0.2: rng.normal(0, scale, shape).astype(np.float32)
    parts = {"out": draw(2 * HIDDEN, TAGS), "out_bias": np.zeros(TAGS, np.float32), "transitions": draw(TAGS, TAGS, scale=0.05), "start": np.zeros(TAGS, np.float32)}
    parts["table"], parts["recurrent"] = draw(2, 130, 4 * HIDDEN, scale=0.5), draw(2, HIDDEN, 4 * HIDDEN)
    return parts


def _windows(text: str, spans: list[Span], rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Characters and tags of windows around spans, in other places than when decoding, and of one anywhere."""
    x, tags = codes(text), np.zeros(len(text), np.int64)
    for kind, start, end in spans:
        tags[start:end] = 2 * KINDS.index(kind) + 2
        tags[start] -= 1
    at = {max(0, s - int(rng.integers(0, WINDOW))) for _, s, _ in spans} | {int(rng.integers(0, max(1, len(text) - WINDOW + 1)))}
    return [(x[a:a + WINDOW], tags[a:a + WINDOW]) for a in sorted(at) if a < len(text)]


def fitted(texts: list[str], spans: list[list[Span]], seed: int = SEED) -> Tagger:
    """Trained on windows of labelled texts that fit in memory."""
    rng = np.random.default_rng(seed)
    model = Tagger(_beginning(rng))
    windows = [w for text, own in zip(texts, spans) for w in _windows(text, own, rng)]
    if not windows:
        return model
    first, second = ({k: np.zeros_like(v) for k, v in model.parts.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        chosen = [windows[i] for i in rng.integers(0, len(windows), BATCH)]
        _step(model, first, second, step, *_padded([c[0] for c in chosen]), _padded([c[1] for c in chosen])[0])
    return model


def _step(model: Tagger, first: dict, second: dict, step: float, x: np.ndarray, length: np.ndarray, tags: np.ndarray) -> None:
    """One step of Adam on the CRF's log likelihood, in place."""
    for k, grad in _gradients(model, x, length, tags).items():
        first[k] += 0.1 * (grad - first[k])
        second[k] += 0.01 * (grad ** 2 - second[k])
        model.parts[k] -= RATE * (1 - step / (STEPS + 1)) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(rows), WINDOW), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out, np.array([len(r) for r in rows])


def _gradients(model: Tagger, x: np.ndarray, length: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
    parts, n = model.parts, len(x)
    scores, states, (gates, candidates, cells, hidden) = model.emissions(x)
    live = np.arange(WINDOW)[None] < length[:, None]
    probability, pairs = model.marginals(scores, length)
    gold = np.eye(TAGS, dtype=scores.dtype)[tags]
    by_score = (probability - gold) * live[:, :, None] / n
    seen = np.zeros((TAGS, TAGS))
    both = live[:, 1:]
    np.add.at(seen, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    grads = {"transitions": (pairs - seen) / n, "start": (probability[:, 0] - gold[:, 0]).sum(0) / n,
             "out": states.reshape(-1, 2 * HIDDEN).T @ by_score.reshape(-1, TAGS), "out_bias": by_score.sum((0, 1))}
    by_state = (by_score @ parts["out"].T).transpose(1, 0, 2)
    by_state = np.stack([by_state[..., :HIDDEN], by_state[::-1, :, HIDDEN:]], 1)
    i, f, o = (gates[..., k * HIDDEN:(k + 1) * HIDDEN] for k in range(3))
    squashed = np.tanh(cells)
    none = np.zeros_like(cells[:1])
    old_c, old_h = np.concatenate([none, cells[:-1]]), np.concatenate([none, hidden[:-1]])
    # What a change of a cell or of a state does to the four gate inputs, for all steps at once.
    by_cell = np.concatenate([candidates * i * (1 - i), old_c * f * (1 - f), none.repeat(WINDOW, 0), i * (1 - candidates ** 2)], 3)
    by_gate, through = squashed * o * (1 - o), o * (1 - squashed ** 2)
    back = parts["recurrent"].transpose(0, 2, 1)
    dh = dc = none[0]
    by_input = np.empty_like(by_cell)
    for t in reversed(range(WINDOW)):
        dh = dh + by_state[t]
        dc = dc + dh * through[t]
        z = np.concatenate([dc] * 4, 2) * by_cell[t]
        z[..., 2 * HIDDEN:3 * HIDDEN] = dh * by_gate[t]
        by_input[t] = z
        dh, dc = z @ back, dc * f[t]
    by_input = by_input.transpose(1, 0, 2, 3).reshape(2, -1, 4 * HIDDEN)
    grads["recurrent"] = old_h.transpose(1, 3, 0, 2).reshape(2, HIDDEN, -1) @ by_input
    marks = np.eye(parts["table"].shape[1], dtype=by_input.dtype)
    grads["table"] = np.stack([marks[v.ravel()].T @ by_input[d] for d, v in enumerate((x.T, x.T[::-1]))])
    return grads


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @; windows overlap by WINDOW - STRIDE."""
    found = set()
    for m in re.finditer("[0-9@]", text):
        last = m.start() // STRIDE
        found.update(k * STRIDE for k in range(max(0, -(-(m.start() - WINDOW + 1) // STRIDE)), last + 1))
    return sorted(found)


def added_spans(model: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans the network adds to ``base`` in each text."""
    places = [(i, a) for i, text in enumerate(texts) for a in window_starts(text)]
    out: list[list[Span]] = [[] for _ in texts]
    if not places:
        return out
    x = {i: codes(texts[i]) for i, _ in places}
    # How deep inside a window each character was read, its tag and the probability of that tag.
    merged = {i: (np.full(len(v), -1), np.zeros(len(v), np.int64), np.zeros(len(v))) for i, v in x.items()}
    for k in range(0, len(places), 256):
        some = places[k:k + 256]
        rows, length = _padded([x[i][a:a + WINDOW] for i, a in some])
        tags, sure = model.decode(rows, length)
        for (i, a), own, p, n in zip(some, tags, sure, length.tolist()):
            j = np.arange(n)
            whole = np.full(n, WINDOW)  # where the window ends with the text
            depth = np.minimum(j if a else whole, n - 1 - j if a + n < len(x[i]) else whole)
            better = depth > merged[i][0][a:a + n]
            for kept, value in zip(merged[i], (depth, own[:n], p[:n])):
                kept[a:a + n][better] = value[better]
    for i, (_, tag, p) in merged.items():
        kind = np.r_[0, (tag + 1) // 2, 0]
        begins = (kind[1:-1] > 0) & ((tag % 2 == 1) | (kind[:-2] != kind[1:-1]))
        ends = (kind[1:-1] > 0) & (np.r_[begins[1:], False] | (kind[2:] != kind[1:-1]))
        for start, last in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist()):
            name, end = KINDS[kind[start + 1] - 1], last + 1
            if p[start:end].mean() >= SURE and _plausible(name, texts[i][start:end]) and not any(s < end and start < e for _, s, e in base[i]):
                out[i].append((name, start, end))
    return out


def _plausible(kind: str, text: str) -> bool:
    """What a span of a kind has to have whatever its form: the checks that base spans pass as well."""
    digits = "".join(re.findall("[0-9]", text))
    if kind == "email":
        return "@" in text[1:-1] and "." in text
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return 9 <= len(digits) <= 15


def trained(docs: DataFrame, sample: int | None = None, longest: int | None = None) -> Tagger:
    """Fitted on all texts that have a digit or an @ and an id, whole, labelled by the patterns.

    Windows around all spans, and one of each text, are dealt into blocks; each block's share of them is learnt from in
    every round. ``sample`` and ``longest`` are for trials: at most ``sample`` texts, the first by a hash of their ids,
    one for each id; of a text over ``longest`` characters so many about its first digit or @.
    """
    rows = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id", "text")
    if longest is not None:
        begin = F.greatest(F.regexp_instr("text", F.lit("[0-9@]")) - longest // 2, F.lit(1))
        rows = rows.withColumn("text", F.when(F.length("text") <= longest, F.col("text")).otherwise(F.substring("text", begin, F.lit(longest))))
    if sample is not None:
        ids = rows.select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
        rows = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def make():
        def run(doc_ids, texts):
            for doc_id, text in zip(doc_ids, texts):
                rng = np.random.default_rng((SEED, doc_id % (1 << 64), zlib.crc32(text.encode("utf-8", "surrogatepass"))))
                for place, (x, tags) in enumerate(_windows(text, base_spans(text), rng)):
                    yield doc_id, place, x.astype(np.uint8).tobytes(), tags.astype(np.uint8).tobytes()
        return run

    windows = batches(rows, make, "doc_id bigint, place int, x binary, tags binary")
    windows, n = dealt(windows.withColumn("key", F.xxhash64("doc_id", "place", "x", "tags")), STEPS * BATCH, "windows")
    parts = _beginning(np.random.default_rng(SEED))
    if n:
        flat = _flat(parts, *({k: np.zeros_like(v) for k, v in parts.items()} for _ in range(2)))
        rounds = ROUNDS if n > STEPS * BATCH else 1
        for turn in range(rounds):
            flat = learnt(windows, flat, _round(turn, rounds))
        parts = _shaped(flat)[0]
    dropped(windows)
    return Tagger(parts)


def _flat(parts: dict, first: dict, second: dict) -> np.ndarray:
    """Parameters, means of gradients and roots of the means of their squares, in rows of 8."""
    values = np.concatenate([v.ravel() for kept in (parts, first, {k: np.sqrt(v) for k, v in second.items()}) for v in kept.values()])
    return np.pad(values, (0, -len(values) % 8)).reshape(-1, 8)


def _shaped(flat: np.ndarray) -> list[dict[str, np.ndarray]]:
    out, at, values = [], 0, flat.ravel()
    for _ in range(3):
        kept = {}
        for k, v in _beginning(np.random.default_rng(SEED)).items():
            kept[k] = values[at:at + v.size].reshape(v.shape).copy()
            at += v.size
        out.append(kept)
    out[2] = {k: v ** 2 for k, v in out[2].items()}
    return out


def _round(turn: int, rounds: int):
    """The steps of one round through a block's windows, from where the round before it ended; all rounds together see each of them."""
    def learn(flat: np.ndarray, block: int, batch: Iterable[pa.RecordBatch]) -> int:
        rows = [(x, t) for part in batch for x, t in zip(part.column("x").to_pylist(), part.column("tags").to_pylist())]
        parts, first, second = _shaped(flat)
        steps = max(-(-STEPS // rounds), -(-len(rows) // (BATCH * rounds)))
        for i in range(steps):
            chosen = [rows[k % len(rows)] for k in range((turn * steps + i) * BATCH, (turn * steps + i + 1) * BATCH)]
            x, length = _padded([np.frombuffer(r[0], np.uint8) for r in chosen])
            tags = _padded([np.frombuffer(r[1], np.uint8) for r in chosen])[0]
            _step(Tagger(parts), first, second, (turn + (i + 1) / steps) * STEPS / rounds, x, length, tags)
        flat[:] = _flat(parts, first, second)
        return len(rows)
    return learn


FOUND = ("doc_id bigint, base array<struct<kind: string, start: int, end: int>>, "
         "added array<struct<kind: string, start: int, end: int>>")


def found(docs: DataFrame, model: Tagger) -> DataFrame:
    """(doc_id, base, added): spans in every whole text, in code points, ends exclusive.

    Null and empty texts have none. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def make():
        def run(doc_ids, texts):
            texts = [t or "" for t in texts]
            base = [base_spans(t) for t in texts]
            for row in zip(doc_ids, base, added_spans(shared.value, texts, base)):
                yield row[0], *([dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in row[1:])
        return run
    return batches(docs.select("doc_id", "text"), make, FOUND)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def digests(docs: DataFrame, model: Tagger) -> DataFrame:
    """Counts of base spans of each kind, a digest of them, and all spans as text."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    spans = found(docs, model)
    return spans.select("doc_id", *map(_count, KINDS), F.sha2(F.array_join(F.transform("base", one), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform(every, one), ",").alias("spans"))


def _count(kind: str):
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def masked(docs: DataFrame, model: Tagger) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` follows the text.

    Spans that overlap become one, named after the first. Null texts stay null.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        def run(*columns):
            rows = dict(zip(names, columns))
            texts = [t or "" for t in rows["text"]]
            base = [base_spans(t) for t in texts]
            new = []
            for old, text, own, more in zip(rows["text"], texts, base, added_spans(shared.value, texts, base)):
                out, at = [], 0
                for k, s, e in sorted([*own, *more], key=lambda x: (x[1], KINDS.index(x[0]))):
                    if s >= at:
                        out += [text[at:s], f"[{k.upper()}]"]
                    at = max(at, e)
                new.append(None if old is None else "".join([*out, text[at:]]))
            rows["text"] = new
            if "n_chars" in rows:
                rows["n_chars"] = [n if t is None else len(t) for n, t in zip(rows["n_chars"], new)]
            return zip(*rows.values())
        return run
    return batches(docs, make, kind)
