"""Order MinHash: fingerprints whose likeness falls with edit distance.

Built from column expressions alone. A text becomes k-mers of word pieces; a k-mer that occurs
again is a new element (k-mer, occurrence). Elements are hashed once and dealt into bins by the
top bits of the hash (one permutation for all bins instead of one for each). A bin keeps its two
smallest elements, puts them back into text order and hashes the pair, so that a slot agrees only
if the same words occur in the same order. No step compares documents with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import let, table

PIECE = r"[^\x20\x09-\x0D]{1,16}"
K = 2
SEED = 42
# A packed element holds a hash above a position; the top bits of the hash are its bin.
POSITION_BITS = 30
HASH_BITS = 33
BIN_BITS = 6


def order_minhash(text: Column, k: int = K, seed: int = SEED) -> Column:
    """Slots of a text as an array of longs (bin in the upper, hash in the lower 32 bits).

    A text without words, empty or null, has no slots. Texts of fewer than ``k`` pieces have
    shorter k-mers. Long words are cut into pieces of 16 characters, so unbroken text works too.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    ids = let(pieces, lambda p: F.transform(p, lambda x, i: _packed(
        F.xxhash64(x, *(F.get(p, i + j) for j in range(1, k))), i.cast("long"))))
    numbered = let(F.sort_array(ids), lambda s: F.transform(s, lambda x, i: _packed(
        F.xxhash64(F.shiftright(x, POSITION_BITS), _occurrence(s, x, i), F.lit(seed)), _position(x))))
    least = let(F.sort_array(numbered), lambda s: F.filter(s, lambda x, i: F.coalesce(_bin(F.get(s, i - 2)) != _bin(x), F.lit(True))))
    return let(least, lambda s: F.array_compact(F.transform(s, lambda x, i: F.when(
        F.coalesce(_bin(F.get(s, i - 1)) != _bin(x), F.lit(True)), _slot(x, F.get(s, i + 1))))))


def _packed(value: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(value, 64 - HASH_BITS), POSITION_BITS).bitwiseOR(position)


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))


def _bin(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS + HASH_BITS - BIN_BITS)


def _occurrence(s: Column, x: Column, i: Column) -> Column:
    """How many equal k-mers stand before ``x`` in the sorted array ``s``; long runs by bisection."""
    own = F.shiftright(x, POSITION_BITS)
    same = lambda j: F.coalesce(F.shiftright(F.get(s, j), POSITION_BITS) == own, F.lit(False))
    steps = F.filter(F.lit([1 << b for b in reversed(range(POSITION_BITS))]), lambda b: b <= i)
    first = F.aggregate(steps, i, lambda j, b: F.when(same(j - b), j - b).otherwise(j))
    return F.when(~same(i - 1), 0).when(~same(i - 2), 1).when(~same(i - 3), 2).otherwise(i - first)


def _slot(x: Column, y: Column) -> Column:
    a, b = F.shiftright(x, POSITION_BITS), F.shiftright(y, POSITION_BITS)
    pair = F.when(_position(x) < _position(y), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
    value = F.when(F.coalesce(_bin(x) == _bin(y), F.lit(False)), pair).otherwise(F.xxhash64(a))
    return F.shiftleft(_bin(x), 32).bitwiseOR(value.bitwiseAND(F.lit(0xFFFFFFFF)))


def as_text(slots: Column) -> Column:
    """A fingerprint as text: ten hex digits for each slot, empty for a text without words."""
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins filled in either fingerprint whose slots agree; 1 for two empty ones."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document, of its edited text, and how alike they are.

    The edited text replaces the second half (rounded down) by the start of the next document in
    ascending ``doc_id`` (nulls first, equal ids by text); after the last comes the first. Null
    texts count as empty. Columns other than ``doc_id`` and ``text`` are not read. An empty table
    gives an empty result; a single document follows itself.

    Neighbours come from one exchange: rows are dealt into ranges of ``doc_id`` whose first ids
    are known, and the rows with such an id also go to the range before, as its last rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    starts = _starts(docs)
    rows = rows.select("doc_id", "text", order_minhash(F.col("text")).alias("slots"), _range(F.col("doc_id"), starts).alias("part"))
    ranges = max(len(starts), 1)
    first = F.col("doc_id").eqNullSafe(F.get(table(starts, "array<bigint>"), F.col("part"))) if starts else F.col("doc_id").isNull()
    own = F.struct(F.col("part"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("part") - 1, F.lit(ranges)).alias("part"), F.lit(1).alias("guest"))
    if starts:
        # Null ids come before all others, so the table then begins with them.
        has_null = docs.where("doc_id is null").limit(1).count() > 0
        at_front = F.col("doc_id").isNull() if has_null else first
        first = F.when(F.col("part") == 0, at_front).otherwise(first)
    rows = rows.select("doc_id", "text", "slots", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    rows = rows.select("doc_id", "text", "slots", "at.part", "at.guest")
    following = Window.partitionBy("part").orderBy("guest", F.asc_nulls_first("doc_id"), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"after": F.lead("text").over(following), "after_slots": F.lead("slots").over(following)}).where("guest = 0")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "slots", "after_slots", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("after", F.lit(1), half)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", "slots", "after_slots", F.sha2("edited", 256).alias("edited_sha256"),
                       order_minhash(F.col("edited")).alias("edited_slots"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("slots")).alias("fingerprint"),
                       as_text(F.col("edited_slots")).alias("edited_fingerprint"),
                       likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
                       likeness(F.col("slots"), F.col("after_slots")).alias("near_next"))


def _starts(docs: DataFrame) -> list[int]:
    """First ids of ranges of about equal numbers of rows, several for each shuffle partition."""
    wanted = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / wanted for i in range(wanted)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * wanted).alias("q"), F.min("doc_id").alias("least")).first()
    return sorted({found["least"], *found["q"]}) if found["q"] else []


def _range(value: Column, starts: list[int]) -> Column:
    """How many starts after the first are at most ``value``, by bisection; nulls are in range 0."""
    if len(starts) < 2:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(starts).bit_length()))]
    reached = lambda j: F.coalesce(F.get(table(starts, "array<bigint>"), j) <= value, F.lit(False))
    return F.aggregate(F.lit(steps), F.lit(0), lambda j, b: F.when(reached(j + b), j + b).otherwise(j))
