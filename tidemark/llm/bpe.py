"""Byte-level BPE by speculation: guess tokens greedily, check all neighbours, merge only failures.

A sequence of tokens is what the merges give if and only if each pair of neighbours is: merging the
bytes of both must give just these two again. So a word is first cut by longest match, then all
pairs of all new words are checked together in numpy by undoing their last merges step by step, and
only words with a pair that fails are merged one merge after another. Words are remembered within a
task, so a text costs one look-up for each word.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import batches

# The pattern that cuts text into words before merging, with white space, letters and
# numbers as in Unicode 16, and the letters and numbers that are newer and so count as symbols.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf"
    "\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    "\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f"
    "\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
SPACE = r"\p{White_Space}"
LETTER, NUMBER = (rf"[\p{{{kind}}}--[{NEWER}]]" for kind in "LN")
OTHER = rf"[^{SPACE}{LETTER}{NUMBER}]"
PATTERN = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?{OTHER}+|{SPACE}+(?![^{SPACE}])|{SPACE}+"

# The same for texts without characters after U+024F, where the plain re module is twice as fast.
BEYOND = re.compile("[^\0-\u024f]")
_LETTER, _NUMBER, _SPACE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
NEAR = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
                  rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
CACHE = 1 << 20
SHORT = 40
NONE = int(np.iinfo(np.int64).max)


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A vocabulary file of byte-level BPE, read once per process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        byte_of, model = _byte_of(), described["model"]
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        ids = {as_bytes(token): n for token, n in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        size = max([*ids.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, n in ids.items():
            self.bytes_of[n] = token
        for token, n in special.items():
            self.bytes_of[n] = token.encode()
        self.ids = ids
        # Tokens are renumbered by rank: bytes first, then merges as listed, so that a smaller
        # number always merges earlier. parts has the two halves of each token's last merge.
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = [(ids[as_bytes(a)], ids[as_bytes(b)]) for a, b in merges]
        made = [ids[self.bytes_of[a] + self.bytes_of[b]] for a, b in pairs]
        self.rank_of = {pair: k for k, pair in reversed(list(enumerate(pairs)))}
        self.made = made
        order = np.full(size, NONE)
        singles = [n for token, n in ids.items() if len(token) == 1]
        order[singles] = np.arange(len(singles))
        for k, n in reversed(list(enumerate(made))):
            order[n] = len(singles) + k
        self.order = order
        by_order = np.zeros(len(singles) + len(made), np.int64)
        by_order[order[singles]] = singles
        self.left = np.arange(len(by_order))
        self.right = self.left.copy()
        for k, (a, b) in enumerate(pairs):
            self.left[len(singles) + k], self.right[len(singles) + k] = order[a], order[b]
        keys = np.array([order[a] * len(by_order) + order[b] for a, b in pairs])
        at = np.argsort(keys, kind="stable")
        self.keys, self.key_order, self.width = keys[at], order[np.array(made)[at]], len(by_order)
        self.most = max(map(len, ids))
        self.longest: dict[bytes, int] = {}
        for token in ids:
            self.longest[token[:2]] = max(self.longest.get(token[:2], 1), len(token))
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_ids = special
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Words and special tokens in order; their concatenation is ``text``."""
        cut = (self.pattern if BEYOND.search(text) else NEAR).findall
        if not self.special or not self.special.search(text):
            return cut(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*cut(text[at:m.start()]), m[0]]
            at = m.end()
        return out + cut(text[at:])

    def propose(self, word: bytes) -> list[int]:
        """Tokens by greedy longest match."""
        out, at, ids = [], 0, self.ids
        while at < len(word):
            for n in range(min(self.longest.get(word[at:at + 2], 1), len(word) - at), 0, -1):
                if (token := ids.get(word[at:at + n])) is not None:
                    out.append(token)
                    at += n
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a and b gives a and b again, for arrays of both.

        Looks from the boundary for a merge across it that would have come before the merges that
        made the tokens as they stand: the younger of the two is undone, again and again.
        """
        x, y = self.order[a], self.order[b]
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        limit = np.full(len(x), NONE)
        while len(live):
            p, q, most = x[live], y[live], limit[live]
            key = p * self.width + q
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            clash = (self.keys[at] == key) & (self.key_order[at] < most)
            good[live[clash]] = False
            undo_left = p > q
            # A merge across the boundary must come before the undone one; at equal rank the left
            # of two overlapping merges wins, hence one more on the right side.
            new_limit = np.where(undo_left, p, q + 1)
            new_p = np.where(undo_left, self.right[p], p)
            new_q = np.where(undo_left, q, self.left[q])
            stuck = np.where(undo_left, new_p == p, new_q == q)
            # One side is a single byte: the other one is undone.
            other = stuck & np.where(undo_left, self.left[q] != q, self.right[p] != p)
            new_q = np.where(other & undo_left, self.left[q], new_q)
            new_p = np.where(other & ~undo_left, self.right[p], new_p)
            new_limit = np.where(other, np.where(undo_left, q + 1, p), new_limit)
            x[live], y[live], limit[live] = new_p, new_q, new_limit
            live = live[~clash & (~stuck | other)]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Tokens by merging pair after pair, the pair of least rank and most to the left first."""
        token = [self.ids[word[i:i + 1]] for i in range(len(word))]
        rank_of = self.rank_of.get
        if len(word) <= SHORT:  # a scan for the least rank is quicker than a heap
            ranks = [rank_of(pair, NONE) for pair in zip(token, token[1:])]
            while ranks and (rank := min(ranks)) < NONE:
                i = ranks.index(rank)
                token[i:i + 2] = [self.made[rank]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank_of((token[i - 1], token[i]), NONE)
                if i < len(ranks):
                    ranks[i] = rank_of((token[i], token[i + 1]), NONE)
            return token
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        heap = [(r, i) for i in range(len(token) - 1) if (r := self.rank_of.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= len(token) or self.rank_of.get((token[i], token[j])) != rank:
                continue
            token[i], token[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < len(token):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(token) and (r := self.rank_of.get((token[k], token[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
        return [t for t in token if t >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode words not seen yet, all at once."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guesses = [self.propose(w) for w in raw]
        sizes = np.array([len(g) for g in guesses])
        flat = np.array([t for g in guesses for t in g], np.int64)
        owner = np.repeat(np.arange(len(guesses)), sizes)
        inside = owner[1:] == owner[:-1]
        pairs, at = np.unique(flat[:-1][inside] * len(self.bytes_of) + flat[1:][inside], return_inverse=True)
        good = self.compatible(pairs // len(self.bytes_of), pairs % len(self.bytes_of))
        failed = set(owner[1:][inside][~good[at]].tolist())
        for i, (word, guess) in enumerate(zip(words, guesses)):
            found = self.merge(raw[i]) if i in failed else guess
            self.known[word] = np.array(found, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; new words are learnt together."""
        cut = [self.words(text) for text in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set().union(*cut)
        for token in new & self.special_ids.keys():
            self.known[token] = np.array([self.special_ids[token]], "<u4").tobytes()
        if new := new - self.special_ids.keys():
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids as bytes, n_tokens, decoded): every whole text encoded and decoded again.

    Null texts count as empty and have no ids. ``path`` is a vocabulary file that all machines have.
    """
    def make():
        own = tokenizer(path)

        def run(doc_ids, texts):
            for doc_id, ids in zip(doc_ids, own.encode([t or "" for t in texts])):
                yield doc_id, ids, len(ids) // 4, own.decode(ids)
        return run
    return batches(docs.select("doc_id", "text"), make, "doc_id bigint, ids binary, n_tokens bigint, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encoded``, with SHA-256 digests instead of ids and text."""
    return encoded(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                      F.sha2("decoded", 256).alias("decoded_sha256"))
