"""Quality rules, among them how many documents of a host share a line.

Lines are normalised and hashed, distinct texts are counted for each host and line, and a line in
more texts than the limit is boilerplate: it goes. A document that loses most of its words that way
is rejected, as is one that fails the rules on its own text. Copies of one text count once, so a
document isn't boilerplate merely because it was copied.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import each
from tidemark.storage import written

# Rules on a document's own text.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

# A line in more distinct texts of its host than LINE_TEXTS goes, however many texts the host has; a document of
# which less than MIN_LEFT of the words stay is rejected.
LINE_TEXTS = 10
MIN_LEFT = 0.3


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, first ones included; exact, without hashing.

    Windows of one, two, four and eight words are numbered in turn, each from two numbers of half
    the length.
    """
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        ids = np.unique(ids[:-size] * (ids.max() + 1) + ids[size:], return_inverse=True)[1]
        size *= 2
    often = np.bincount(ids)[ids] > 1
    steps = np.zeros(len(words) + 1, np.int64)
    steps[:len(ids)] += often
    steps[window:window + len(ids)] -= often
    return int((steps.cumsum() > 0).sum())


def line_key(words: list[bytes]) -> int:
    """Hash of a line as its words with single spaces, A-Z in lower case."""
    return xxhash.xxh64_intdigest(b" ".join(words).lower()) - (1 << 63)


def _cut(text: str) -> list[tuple[bytes, list[bytes]]]:
    """Lines and their words; bytes.split() cuts at the six ASCII white-space characters alone."""
    return [(line, line.split()) for line in text.encode("utf-8", "surrogatepass").split(b"\n")]


def _measured(doc_id, content, host, text):
    text = text or ""
    seen, dup, lines, words = set(), 0, {}, []
    for line, own in _cut(text):
        if own:
            words += own
            dup += line in seen
            seen.add(line)
            key = line_key(own)
            lines[key] = lines.get(key, 0) + len(own)
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    return (doc_id, content, host, len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat, failed,
            [{"line": k, "n": n} for k, n in lines.items()])


MEASURED = ("doc_id bigint, content bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
            "n_repeat_words bigint, base_failed boolean, lines array<struct<line: bigint, n: bigint>>")


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measures of every whole text, and its distinct lines with their words."""
    return each(_told_apart(docs, host).select("doc_id", "content", "host", "text"), lambda: _measured, MEASURED)


def _told_apart(docs: DataFrame, host: str) -> DataFrame:
    return docs.withColumns({"content": F.xxhash64("text"), "host": F.col(host).cast("string")})


def common_lines(measures: DataFrame, limit: int = LINE_TEXTS) -> DataFrame:
    """(host, line) of lines in more than ``limit`` distinct texts of a host; nulls are one host.

    The limit is a number of texts, so texts that do not hold a line have no say in it.
    """
    texts = measures.select("host", "content", F.explode("lines.line").alias("line"))
    return texts.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("host", "line")


def _row() -> Column:
    """One number for id, text and host, nulls marked: repeated rows share it, others do not."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "content", F.col("host").isNull(), "host")


def _in_common(measures: DataFrame, limit: int) -> DataFrame:
    """(row, line, n) of the common lines in each document, once for repeated rows."""
    common = common_lines(measures, limit).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    lines = measures.select(_row().alias("row"), "host", F.explode("lines").alias("l")).select("row", "host", "l.*")
    return lines.join(common, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host"))).select("row", "line", "n").distinct()


def judged(docs: DataFrame, host: str = "source", limit: int = LINE_TEXTS) -> DataFrame:
    """One row for each document with its measures, the words that stay, and whether it is kept.

    Lines in more than ``limit`` texts of their host do not stay.

    Null and empty texts have no words and fail the base rules. Rows that share an id, or have
    none, are judged one by one. An empty table gives an empty result.
    """
    return _judged(written(measured(docs, host), "measures"), limit).drop("row")


def _judged(measures: DataFrame, limit: int) -> DataFrame:
    lost = _in_common(measures, limit).groupBy("row").agg(F.sum("n").alias("lost"), F.count("*").alias("n_common_lines"))
    out = measures.drop("lines").withColumn("row", _row()).join(lost, "row", "left")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    return out.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.coalesce("n_common_lines", F.lit(0)).alias("n_common_lines"), left.alias("words_left"),
                      (~F.col("base_failed") & (left >= MIN_LEFT * F.col("n_words"))).alias("kept"))


def cleaned(docs: DataFrame, host: str = "source", limit: int = LINE_TEXTS) -> DataFrame:
    """The documents that are kept, without the lines that more than ``limit`` texts of their host share.

    All columns stay; ``content`` and ``host`` are replaced if there are such columns already.
    """
    measures = written(measured(docs, host), "measures")
    lines = _in_common(measures, limit).groupBy("row").agg(F.collect_set("line").alias("common"))  # of one document
    kept = _judged(measures, limit).where("kept").select(F.col("row").alias("_row")).distinct()
    rows = _told_apart(docs, host).withColumn("_row", _row()).join(kept, "_row", "left_semi")
    rows = rows.join(lines.withColumnRenamed("row", "_row"), "_row", "left").drop("_row", "content")
    names = [f.name for f in rows.schema if f.name not in ("common", "text")]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("common", "text"))

    def without(text, common, *others):
        if common:
            gone = set(common)
            text = b"\n".join(line for line, words in _cut(text) if not words or line_key(words) not in gone).decode("utf-8", "surrogatepass")
        return (text, *others)
    return each(rows.select("text", "common", *names), lambda: without, f"text string, {kind}")
