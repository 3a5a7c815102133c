"""Small helpers the text operators share."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidemark.storage import dropped, written

# Fixed value: a word is a run of characters other than space and the five ASCII line controls.
WORD = r"[^\x20\x09-\x0D]+"
SLICE = 512  # texts that are Python objects at a time,
SLICE_BYTES = 1 << 22  # and how long these are together, unless a single one is longer
SAMPLE_CHARS = 1 << 26  # of all texts of a sample
SCALE = 1 << 24  # changes of a model are summed as whole numbers of this part


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def table(values: list, kind: str) -> Column:
    """A list of numbers, nested or not, as one constant."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def slices(part: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``SLICE`` rows and ``SLICE_BYTES`` bytes of text, or of one row."""
    texts = [c for c in part.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64) for c in texts), np.zeros(part.num_rows, np.int64))
    until = sizes.cumsum()
    begin = 0
    while begin < part.num_rows:
        most = until[begin] - sizes[begin] + SLICE_BYTES
        end = min(begin + SLICE, max(int(np.searchsorted(until, most, side="right")), begin + 1))
        yield begin, min(end, part.num_rows)
        begin = end


def batches(frame: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Rows made from slices of Arrow batches.

    ``make`` runs once per task and returns a function of one list for each column of ``frame``
    that gives rows of ``schema``; state that it keeps, such as a cache, lives as long as a task.
    """
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for part in parts:
            for begin, end in slices(part):
                rows = list(function(*(column.to_pylist() for column in part.slice(begin, end - begin).columns)))
                columns = zip(*rows) if rows else [()] * len(kind)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    return frame.mapInArrow(run, schema)


def each(frame: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row for each input row; as ``batches`` with a function of single values."""
    def make_all():
        function = make()
        return lambda *columns: map(function, *columns)
    return batches(frame, make_all, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b), the component being its least node.

    Rounds of large and small stars: each node's neighbours are linked to the least of them,
    first the larger neighbours, then the smaller ones. Every round is written to the shared
    folder, so plans stay small and a lost executor costs one round. Neither step gathers a
    node's neighbours: a partial minimum comes first, and the join back splits skewed keys.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        small = written(small, "links")
        same = _sum_of(small) == _sum_of(edges)
        dropped(edges)
        dropped(large)
        edges = small
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _sum_of(edges: DataFrame) -> tuple:
    # xxhash64 halves are summed apart, as a sum of whole hashes could overflow.
    key = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(key.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(key, 32))).first())


def sampled(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, chars: int = SAMPLE_CHARS) -> list:
    """At most ``most`` labelled documents (doc_id, text, lang and ``columns``) of ``chars`` characters in all, in an order by hash.

    For trials on the driver: no model of this library is learnt from it, see ``labelled`` and ``learnt``.
    The ids are chosen from ``labels`` alone; they are at most ``most``, so sending them to all
    tasks is safe. Of rows that share an id the one of least text and language is taken. What reaches the driver is
    bounded by ``most`` and ``chars``: the documents that would exceed ``chars`` are left out, the last ones first.
    """
    order = F.md5(F.col("doc_id").cast("string"))
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    ids = ids.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(most)
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", *columns).agg(F.min(F.struct("text", "lang")).alias("least")).select("doc_id", "least.*", *columns)
    # One row for each of at most ``most`` ids: the running sum may go through one task.
    so_far = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_chars", so_far).where(F.col("_chars") <= chars).drop("_chars").collect()
    return sorted(rows, key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))


def labelled(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """All labelled documents (doc_id, text, lang, ``column``), one row an id.

    The greatest label of an id counts, and of rows that share an id the one of least text and language.
    """
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(column).alias(column))
    rows = docs.select("doc_id", "text", "lang").join(ids, "doc_id")
    return rows.groupBy("doc_id", column).agg(F.min(F.struct("text", "lang")).alias("least")).select("doc_id", "least.*", column)


def dealt(lessons: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """``lessons`` written in blocks of about ``size`` rows, and their number.

    A row's block (column ``block``) and its place there follow from its hash ``key`` alone, so what a model
    learns doesn't depend on files, partitions or machines.
    """
    first = written(lessons, name)
    rows = first.count()
    blocks = max(1, -(-rows // size))
    rest = [c for c in first.columns if c != "key"]
    out = first.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).repartition(blocks, "block")
    out = written(out.sortWithinPartitions("block", "key", *rest), name)
    dropped(first)
    return out, rows


def _by_block(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for part in parts:
        blocks = part.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield int(blocks[a]), part.slice(a, b - a)


def learnt(lessons: DataFrame, model: np.ndarray, learn: Callable[[np.ndarray, int, Iterable[pa.RecordBatch]], int]) -> np.ndarray:
    """The model after one round over all blocks of ``lessons``.

    Every block starts from ``model``; ``learn`` changes its copy in place, reading the block's batches as they
    come, and gives the number of lessons. Spark adds up the changes by row of the model, and each row moves by the
    mean over the blocks that changed it, weighted by their lessons. Sums are of whole numbers, so their order
    doesn't matter. The driver receives at most one row for each row of the model.
    """
    shared = lessons.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = [f"c{k}" for k in range(model.shape[1])]
    schema = "at int, n bigint, " + ", ".join(f"{c} bigint" for c in names)
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in groupby(_by_block(parts), itemgetter(0)):
            new = shared.value.copy()
            n = learn(new, block, (part for _, part in own))
            at = np.flatnonzero((new != shared.value).any(1))
            change = np.rint((new[at].astype(float) - shared.value[at]) * SCALE).astype(np.int64) * n
            columns = [at.astype(np.int32), np.full(len(at), n, np.int64), *np.ascontiguousarray(change.T)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=kind)

    sums = lessons.mapInArrow(run, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).where("n > 0").toArrow()
    shared.destroy()
    out = model.copy()
    weight = sums["n"].to_numpy() * float(SCALE)
    for k, c in enumerate(names):
        out[sums["at"].to_numpy(), k] += sums[c].to_numpy() / weight
    return out
