"""SimHash near-duplicates, linked by meeting half-way between fingerprints.

Two fingerprints within three bits meet in the middle: each emits the variants within half the
radius and equal variants are brought together by a shuffle. Half of three is one and a half, so
the work is done in two passes that both flip at most one bit.

* Two fingerprints within two bits share a variant of one flipped bit, and whoever shares such a
  variant is within two bits. All who share one are linked to the least of them: no pairs are
  formed and nothing needs verifying.
* Of two fingerprints exactly three bits apart, one half of the bits differs in two or three. With
  that half blanked they are equal or one bit apart, and then of different parity: those of odd
  parity emit their variants of one flipped bit, and all emit themselves. What collides and is not
  of one group after the first pass is verified inside the join.

Emitting all variants within two bits instead (2,081 for each fingerprint) would need no second
pass, but shuffles over twenty times as many rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import components, each
from tidemark.storage import written

SHINGLE = 3
SEED = 42
RADIUS = 3
HALF = 32


def simhash(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    # bytes.lower() maps A-Z alone and bytes.split() cuts at the six ASCII white-space characters.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    counts = np.zeros(64, np.int64)
    n = 0
    while True:
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for _, s in zip(range(1 << 16), shingles)), np.uint64)
        if not len(hashes):
            break
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        if not hasattr(shingles, "__next__"):
            break
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text. Null and empty texts have 0."""
    return each(docs.select("doc_id", "text"), lambda: lambda doc_id, text: (doc_id, simhash(text)), "doc_id bigint, fp bigint")


def groups(prints: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``prints`` (doc_id, fp).

    A component holds all documents that can be reached over links of at most three differing
    bits; its id is the least ``doc_id`` in it. Documents with equal fingerprints are linked, those
    without words (fingerprint 0) among each other like any others. Null ids take part in links but
    never name a component unless all its ids are null. An empty table gives an empty result.
    """
    prints = written(prints, "prints")
    grouped = _linked(prints)
    named = grouped.join(grouped.groupBy("grp").agg(F.min("least").alias("component_id")), "grp").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _linked(prints: DataFrame) -> DataFrame:
    """(fp, least, grp) for each fingerprint: its least id and the least fingerprint of its component."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    close = components(_within_two(distinct.select("fp")))
    grouped = written(distinct.join(close, F.col("fp") == F.col("node"), "left")
                      .select("fp", "least", F.coalesce("component", "fp").alias("grp")), "groups")
    joined = components(_three_apart(grouped.select("fp", "grp")))
    return grouped.join(joined, F.col("grp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "grp").alias("grp"))


def _spread(distinct: DataFrame) -> DataFrame:
    """Small files would give a few tasks, and variants multiply what each of them holds."""
    return distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def _flips(value: Column, bits: int) -> Column:
    """``value`` and its variants with one of the lowest ``bits`` bits flipped."""
    masks = [0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(bits)]
    return F.transform(F.lit(masks), lambda m: m.bitwiseXOR(value))


def _within_two(distinct: DataFrame) -> DataFrame:
    """Links (a, b) from each fingerprint to the least one it shares a variant with."""
    met = _spread(distinct).select("fp", F.explode(_flips(F.col("fp"), 64)).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    return met.select(F.col("fp").alias("a"), least.alias("b")).where("a <> b").distinct()


def _three_apart(grouped: DataFrame) -> DataFrame:
    """Links (a, b) between groups that hold fingerprints three bits apart."""
    low, high = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned("fp", HALF)
    halves = F.explode(F.array(*(F.struct(F.lit(k).alias("half"), v.alias("bits")) for k, v in enumerate((low, high)))))
    rows = _spread(grouped).select("fp", "grp", halves.alias("k")).select("fp", "grp", "k.half", "k.bits")
    variants = F.when(F.bit_count("bits") % 2 == 1, _flips(F.col("bits"), HALF)).otherwise(F.array("bits"))
    met = rows.select("fp", "grp", "half", F.explode(variants).alias("bits")).alias("l")
    own = rows.alias("r")
    apart = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp")))
    return (met.join(own, (F.col("l.half") == F.col("r.half")) & (F.col("l.bits") == F.col("r.bits")) & (F.col("l.grp") != F.col("r.grp")) & (apart <= RADIUS))
            .select(F.col("l.grp").alias("a"), F.col("r.grp").alias("b")).distinct())


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one with the least id, of equal ids the least text.

    Documents with a null id stay only if all ids of their group are null, then one of them. Rows
    are told apart by id and text, so unlike texts that share an id, or have none, all stay.
    """
    rows = docs.withColumn("_content", F.md5("text"))
    prints = written(each(rows.select("doc_id", "text", "_content"), lambda: lambda doc_id, text, content: (doc_id, content, simhash(text)),
                          "doc_id bigint, _content string, fp bigint"), "prints")
    found = prints.join(_linked(prints).select("fp", "grp"), "fp").select("grp", "doc_id", "_content")
    each_id = found.groupBy("grp", "doc_id").agg(F.count("*").alias("n"), F.min("_content").alias("_content"))
    least = each_id.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "_content")).alias("l"))
    least = written(least.select("grp", F.col("l.doc_id").alias("_id"), "l.n", F.col("l._content").alias("_key")), "survivors")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_content").eqNullSafe(F.col("_key"))
    single = rows.join(least.where("n = 1").select("_id", "_key"), same, "left_semi").select(*docs.columns)
    # Only rows whose id occurs again in the group are compared, as a partial minimum of the whole row.
    often = least.where("n > 1").select(F.col("grp").alias("_grp"), "_id")
    again = found.join(often, (F.col("grp") == F.col("_grp")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    again = again.select("grp", "_id", F.col("_content").alias("_key")).distinct()
    names = [F.col(c) for c in docs.columns]
    again = rows.join(again, same).groupBy("grp").agg(F.min(F.struct("text", F.struct(*names).alias("_row"))).alias("_least"))
    return single.unionByName(again.select("_least._row.*"))
