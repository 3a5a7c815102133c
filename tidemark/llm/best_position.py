"""Ranked lexical search with the Best Position Algorithm.

Documents are tokenised once into an index of the terms that the queries hold: for each document its length and
its (term, occurrences) pairs, written to the shared folder. Lengths and document frequencies are sums
over that index. It is then searched in shards. A shard is as many documents as hold ``POSTINGS``
postings; each term has a list of its documents there by falling impact. A query reads its lists
downwards, a block at a time, and looks up every document it meets in all its other lists. The best position of a
list is the last one up to which all positions were seen, by reading or by looking up, so it may lie
well below the last one read. What the impacts at the best positions add up to bounds all unseen documents; the search of
a shard ends once that is strictly below the score of the k-th, so documents that tie with it are all seen.
What earlier shards of a task have found raises that score for later ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import batches
from tidemark.storage import written

# Fixed values of the score: parts of one impact, and how a document's length counts (in hundredths).
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 12, 25
TOP = 20
POSTINGS = 1 << 21  # of a shard: about 100 MB of lists
BLOCK_CHARS = 1 << 24  # query texts that are searched for together
FIRST_READ = 32  # positions of each list in the first block; every further block is twice as long

# Fixed value: A-Z become a-z, all other bytes below 0x80 but digits and a-z become spaces. Bytes from 0x80
# on only occur in characters that belong to terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; none for null."""
    return text.translate(TERM_BYTES).split() if text else []


def indexed(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Length and postings of each row of ``docs``: doc_id, n_terms, terms (numbers in ``vocabulary``), counts.

    All terms count towards n_terms, only those of ``vocabulary`` have postings. Every row has one row, null
    and empty texts without terms. Columns other than doc_id and text are not read.
    """
    def make() -> Callable[..., Iterable[tuple]]:
        number = {term: i for i, term in enumerate(vocabulary)}

        def rows(ids: list, texts: list) -> Iterator[tuple]:
            for doc_id, text in zip(ids, texts):
                found = terms(text)
                counts = Counter(map(number.get, found))
                counts.pop(None, None)
                yield doc_id, len(found), list(counts.keys()), list(counts.values())
        return rows
    return batches(docs.select("doc_id", F.col("text").cast("binary")), make, "doc_id long, n_terms long, terms array<int>, counts array<long>")


class Shard:
    """Impact lists of the documents of one shard.

    ``doc`` and ``impact`` hold all lists one after the other, ``begin`` where each begins. ``by_doc`` and ``place`` find the
    position of a document in a list: the documents of the list in order, and their positions.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        position = np.arange(len(order)) - np.repeat(self.begin[:-1], np.diff(self.begin))
        back = np.lexsort((self.doc, term[order]))
        self.by_doc, self.place = self.doc[back], position[back]

    def find(self, term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``docs`` are in a term's list, and the positions of those."""
        begin, end = self.begin[term], self.begin[term + 1]
        at = np.minimum(np.searchsorted(self.by_doc[begin:end], docs), end - begin - 1)
        there = self.by_doc[begin + at] == docs
        return there, self.place[begin + at[there]]

    def best(self, query: list[tuple[int, int]], top: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of the ``top`` highest scores and all that tie with the last of them, their scores, and how many were looked up.

        ``query`` has (term, weight) pairs, each term once. Documents that score less than ``floor`` may be left out.
        """
        lists = [(t, q, self.begin[t], self.begin[t + 1] - self.begin[t]) for t, q in query]
        lists = [x for x in lists if x[3]]
        seen = [np.zeros(n + 1, bool) for *_, n in lists]  # the last stands for the end and stays unseen
        known, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, read = 0, FIRST_READ
        while True:
            fresh = [self.doc[begin + done:begin + min(n, read)] for _, _, begin, n in lists if done < n]
            fresh = np.setdiff1d(np.concatenate(fresh), known) if fresh else known[:0]
            total = np.zeros(len(fresh), np.int64)
            for (t, q, begin, _), flags in zip(lists, seen):
                there, place = self.find(t, fresh)
                total[there] += q * self.impact[begin + place]
                flags[place] = True
            known, scores = np.concatenate([known, fresh]), np.concatenate([scores, total])
            least = int(np.partition(scores, -top)[-top]) if len(scores) >= top else 1
            least = max(least, floor, 1)
            # The bound by the first position not seen, which is tighter still than the best position itself.
            unseen = [int(np.argmin(flags)) for flags in seen]
            bound = sum(q * int(self.impact[begin + i]) for (_, q, begin, n), i in zip(lists, unseen) if i < n)
            if bound < least:
                keep = scores >= least
                return known[keep], scores[keep], len(known)
            done, read = read, read * 2


def _searched(index: DataFrame, queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_all: int, top: int) -> DataFrame:
    """The best documents for each query (by number) within each task's part of ``index``: query, doc_id, score."""
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}

        def search(batch: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(batch).combine_chunks()
            length = rows["n_terms"].to_numpy()
            lists = rows["terms"].combine_chunks()
            doc = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
            term = lists.flatten().to_numpy()
            count = rows["counts"].combine_chunks().flatten().to_numpy()
            m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * n_docs // max(n_all, 1)
            shard = Shard(term, doc, weights[term] * (SCALE * count // (1000 * count + SATURATION * m[doc])), len(weights))
            ids = rows["doc_id"].to_pylist()
            for number, query in enumerate(queries):
                own = best.setdefault(number, [])
                floor = -own[-1][0] if len(own) >= top else 0
                docs, scores, _ = shard.best(query, top, floor)
                own += [(-s, ids[d] is None, ids[d]) for d, s in zip(docs.tolist(), scores.tolist())]
                own.sort()
                del own[top:]

        held, size = [], 0
        for part in parts:
            held.append(part)
            size += len(part.column("terms").flatten())
            if size >= POSTINGS:
                search(held)
                held, size = [], 0
        if held:
            search(held)
        rows = [(number, row[2], -row[0]) for number, own in best.items() for row in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, schema)], schema=schema)

    return index.where(F.size("terms") > 0).mapInArrow(run, "query int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` highest-scoring rows of ``docs`` for each item: item_id, rank, doc_id, score.

    Scores are exact whole numbers; ties are ranked by ascending doc_id, nulls last, and only scores above 0 are
    returned. Each row of ``docs`` is a document, so rows that repeat can both be ranked. Rows of ``items`` (item_id,
    text) that are equal are one item; rows that share an id and differ in text are ranked apart. An item without terms
    (null, empty), or without any document that holds one of weight, has no rows; nor has any for empty tables. Other columns are not read.

    Items are searched for in blocks by hash, so that neither driver nor tasks hold more than about ``BLOCK_CHARS``
    characters of them (a longer text is a block of its own at worst); each block reads the documents anew.
    """
    asked = items.select("item_id", "text").distinct()
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = _ranked_block(docs, part, top)
        found = rows if found is None else found.union(rows)
    return found


def _ranked_block(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    rows = items.select("item_id", F.col("text").cast("binary")).collect()
    asked = [(r["item_id"], Counter(terms(r["text"]))) for r in rows]
    vocabulary = sorted(set().union(*[c for _, c in asked]))
    number = {term: i for i, term in enumerate(vocabulary)}
    index = written(indexed(docs, vocabulary), "postings")
    sums = index.agg(F.count(F.when(F.col("n_terms") > 0, 1)).alias("docs"), F.sum("n_terms").alias("all")).first()
    n_docs, n_all = sums["docs"], sums["all"] or 0
    # At most one row for each term of the block's items.
    frequency = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    queries = [sorted((number[w], n) for w, n in counts.items() if weights[number[w]] > 0) for _, counts in asked]
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], "query int, item_id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = _searched(index, queries, weights, n_docs, n_all, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
