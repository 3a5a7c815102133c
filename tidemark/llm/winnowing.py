"""Benchmark decontamination by winnowing.

Every ``K`` consecutive words are hashed, and of each window of such hashes the least is kept. A span
of ``SPAN`` words holds one whole window of hashes, so two texts that share the span keep the same
hash in it: no shared span is missed, though only about two hashes in seven are kept. Kept hashes
of documents are joined with those of the benchmark; around each agreement the spans of ``SPAN`` words are
then compared word by word with those of the benchmark.

Built from column expressions alone. Texts are read once for every ``BLOCK_GRAMS`` fingerprints of the benchmark and never
shuffled: a task keeps the few words around each agreement, and only these are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import let
from tidemark.storage import dropped, written

# Fixed value: what stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = 10
K = 5
POSITION_BITS = 31
BLOCK_GRAMS = 1 << 20  # fingerprints of the benchmark that are broadcast at a time: about 50 MB


def words(text: Column) -> Column:
    """The words of a text, with A-Z and no other letters lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def grams(of: Column, k: int) -> Column:
    """For each ``k`` consecutive words a hash (33 bits) above its position (31 bits), as a long."""
    def one(i: Column) -> Column:
        return F.shiftleft(F.xxhash64(*[F.get(of, i + j) for j in range(k)]), POSITION_BITS).bitwiseOR(i.cast("long"))
    return F.when(F.size(of) >= k, F.transform(F.sequence(F.lit(0), F.size(of) - k), one)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(of: Column, span: int) -> Column:
    """The grams that winnowing keeps, for spans of ``span`` words; equal least hashes: the first.

    A span of fewer than ``SPAN`` words is one gram of its own, and all of those are kept.
    """
    # ``of`` is bound first: moved into a filter, it would else be split anew for every gram.
    if span < SPAN:
        return let(of, lambda w: grams(w, span))
    size = SPAN - K + 1

    def least(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(g) - size), lambda i: F.least(*[F.get(g, i + j) for j in range(size)]))
    return let(let(of, lambda w: grams(w, K)), lambda g: F.when(F.size(g) >= size, F.array_distinct(least(g))).otherwise(F.array().cast("array<bigint>")))


def joined(of: Column, start: Column, n: Column, most: int = SPAN) -> Column:
    """``n`` words, at most ``most``, from word ``start`` on as one text; its cost is that of these words alone."""
    return F.concat_ws(" ", *[F.when(n > j, F.get(of, start + j)) for j in range(most)])


class Benchmark:
    """The spans of a benchmark and their fingerprints, as tables written to the shared folder.

    ``items`` has ``item_id`` and ``text``. An item of fewer than ``SPAN`` words, but at least one, is one
    span; one without words (null, empty) has none. Items that share an id are one item with the
    spans of both; an item without id taints texts but is not counted or named. Other columns are not read.
    """

    def __init__(self, items: DataFrame):
        items = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
        span = F.least(F.size("words"), F.lit(SPAN))
        texts = let(F.col("words"), lambda w: F.transform(
            F.sequence(F.lit(0), F.size(w) - F.least(F.size(w), F.lit(SPAN))), lambda i: joined(w, i, F.lit(SPAN))))
        found = items.select("item_id", F.explode(texts).alias("span_text")).distinct()
        members = written(found, "members")
        # At most SPAN different lengths.
        self.spans = sorted(r[0] for r in items.select(span).distinct().collect())
        # Numbers given while writing stay the same for all who read the table.
        self.texts = written(members.select("span_text").distinct().withColumn("span_id", F.monotonically_increasing_id()), "spans")
        self.members = written(members.where("item_id is not null").join(self.texts, "span_text").select("span_id", "item_id"), "items")
        dropped(members)
        kept = [items.where(span == n).select(F.lit(n).alias("span"), F.explode_outer(fingerprints(F.col("words"), n)).alias("kept")) for n in self.spans]
        kept = reduce(DataFrame.union, kept) if kept else items.where("false").selectExpr("0 as span", "0L as kept")
        self.grams = written(kept.where("kept is not null").select("span", F.shiftright("kept", POSITION_BITS).alias("gram")).distinct(), "grams")

    def blocks(self) -> list[DataFrame]:
        """The fingerprints (span, gram) in parts of about ``BLOCK_GRAMS``, at least one; each is small enough to broadcast."""
        many = -(-self.grams.count() // BLOCK_GRAMS) or 1
        return [self.grams.where(F.pmod(F.xxhash64("gram"), F.lit(many)) == block) for block in range(many)]


def overlaps(docs: DataFrame, benchmark: Benchmark) -> tuple[DataFrame, DataFrame]:
    """The documents by digest of their text, and all spans that a digest's text shares with the benchmark.

    The first table has one row for each row of ``docs`` (doc_id, digest, n_words); a null text has a null
    digest and no words. The second has (digest, start, span, span_id), each once: ``span`` words
    from word ``start`` (from 0) on are a span of the benchmark. Both are empty for an empty table.
    """
    digest = F.md5(F.col("text").cast("binary"))
    split = docs.select("doc_id", digest.alias("digest"), words(F.col("text")).alias("words"))
    # A null stands for the document itself, so that documents and agreements come out of one pass.
    kept = F.concat(F.array(F.lit(None).cast("bigint")), *[fingerprints(F.col("words"), n) for n in benchmark.spans])
    # The array is a column before it is exploded, so that generated code runs through explode, join and filter at once
    # and words are not copied for every kept gram. An inner explode would be filtered by its own length, computed apart.
    kept = split.select("doc_id", "digest", "words", kept.alias("all")).select("doc_id", "digest", "words", F.explode_outer("all").alias("kept"))
    n = F.size("words")
    at, whole = F.col("kept").bitwiseAND((1 << POSITION_BITS) - 1).cast("int"), F.col("span") == SPAN
    start = F.when(whole, F.greatest(at - (SPAN - K), F.lit(0))).otherwise(at)
    length = F.when(whole, F.least(at + SPAN, n)).otherwise(at + F.col("span")) - start
    rows, found = None, None
    for grams in benchmark.blocks():
        # The words around an agreement are read off while the document is at hand; nothing else of a text leaves its task.
        met = kept.join(F.broadcast(grams), F.shiftright("kept", POSITION_BITS) == F.col("gram"), "left")
        met = met.where("kept is null or span is not null").select(
            "doc_id", "digest", n.cast("long").alias("n_words"), "span", F.when(F.col("span").isNotNull(), start).alias("start"),
            F.when(F.col("span").isNotNull(), joined(F.col("words"), start, length, 2 * SPAN - K)).alias("around"))
        met = written(met, "agreements")
        hits = met.where("span is not null").select("digest", "span", "start", "around").distinct()
        rows = rows or met.where("span is null").select("doc_id", "digest", "n_words")
        found = hits if found is None else found.union(hits)
    spans = let(F.split("around", " "), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - F.col("span")), lambda i: F.struct(
        (F.col("start") + i).alias("start"), joined(w, i, F.col("span")).alias("span_text"))))
    found = found.select("digest", "span", F.explode_outer(spans).alias("s")).select("digest", "span", "s.*").distinct()
    found = found.join(benchmark.texts, "span_text").select("digest", "start", "span", "span_id")
    return rows, written(found, "overlaps")


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each row of ``docs`` with what it shares with the benchmark.

    ``hit`` lists the merged ranges of hit words (begin, end exclusive) and ``items`` the ids of the items that share
    a span with the text, as strings in order. Columns are doc_id, n_words, hit, n_hit, items. Rows with equal
    ids or texts are judged one by one, so repeated rows have equal results; null and empty texts, and
    all texts if the benchmark is empty, share nothing. Columns other than doc_id and text are not read.
    """
    benchmark = Benchmark(items)
    rows, found = overlaps(docs, benchmark)
    spans = F.collect_list(F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("span")).alias("end")))
    found = found.groupBy("digest").agg(merged(spans).alias("hit"), F.sort_array(F.collect_set("span_id")).alias("ids"))
    found = written(found.withColumn("set", F.md5(F.array_join("ids", ",").cast("binary"))), "hits")
    # Texts that share the same spans share the same items: those are looked up once.
    named = found.select("set", "ids").dropDuplicates(["set"]).select("set", F.explode("ids").alias("span_id"))
    named = named.join(benchmark.members, "span_id").select("set", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("set").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = found.select("digest", "hit", "set").join(named, "set", "left").drop("set")
    none = F.array()
    return rows.join(written(found, "judged"), "digest", "left").select(
        "doc_id", "n_words", F.coalesce("hit", none.cast("array<struct<begin:int,end:int>>")).alias("hit"),
        F.coalesce(F.aggregate("hit", F.lit(0).cast("long"), lambda n, r: n + r.end - r.begin), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none.cast("array<string>")).alias("items"))


def merged(spans: Column) -> Column:
    """Ranges (begin, end exclusive) in any order as ranges that neither meet nor overlap, in order."""
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s.begin, s.end - 1)))))

    def runs(p: Column) -> Column:
        begins = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1) < x - 1, F.lit(True)))
        ends = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) > x + 1, F.lit(True)))
        return F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("begin"), (e + 1).alias("end")))
    return let(places, runs)


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As ``judged``, with digests instead of lists: n_items, items_sha256, contaminated."""
    found = judged(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, in all their columns, whose text shares no span with the benchmark.

    Rows are told apart by their text alone; null and empty texts stay, and all do if the benchmark is empty.
    """
    _, found = overlaps(docs, Benchmark(items))
    digest = "_digest"
    while digest in docs.columns:
        digest += "_"
    tainted = found.select(F.col("digest").alias(digest)).distinct()
    return docs.withColumn(digest, F.md5(F.col("text").cast("binary"))).join(tainted, digest, "left_anti").select(*docs.columns)
