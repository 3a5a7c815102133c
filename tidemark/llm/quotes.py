"""Conversations out of messages that quote each other.

A message's lines carry quote marks; their number is the nesting level. Each passage (a line without
its marks, normalised) is hashed. So are all lines of one level together, alone and with all lines
of the next level: what a message writes and quotes is a level deeper in the replies to it. What is
written in a message, at level 0, makes an index from hash to the earliest message that wrote it:
one row for each hash, so a passage that very many messages share joins once for each quote and
never pairs messages. A message replies to the one whose text and quotes it quotes, else to the one
whose whole text, else to the one that most of its first-level quotes come from; where nobody is
known to have written these, to the one that the next level gives in the same way. Chains of replies are followed by doubling, which takes as
many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import dropped, written

# Fixed value: quote marks at the start of a line, blanks between them allowed.
MARKS = r"^[\x20\x09]*(?:>[\x20\x09]*)+"


def passages(messages: DataFrame) -> DataFrame:
    """(message, place, level, body, key): the lines of every message; blank ones have no key.

    ``messages`` has ``message`` (text, unique), ``sent`` (orderable) and ``text``; a null text has
    no lines.
    """
    lines = messages.select("message", "sent", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    body = F.regexp_replace("line", MARKS, "")
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    plain = F.trim(F.regexp_replace(F.lower(body), r"[\x20\x09-\x0D]+", " "))
    return lines.select("message", "sent", "place", level.alias("level"), body.alias("body"), F.when(plain != "", F.xxhash64(plain)).alias("key"))


def _marked(lines: DataFrame) -> DataFrame:
    """(message, sent, level, kind, key, n): single lines, all of a level, and these with the next level."""
    lines = lines.where("key is not null")
    single = lines.groupBy("message", "sent", "level", "key").agg(F.count("*").alias("n"))
    whole = lines.groupBy("message", "sent", "level").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("keys"))
    whole = whole.select("message", "sent", "level", F.xxhash64(F.transform("keys", lambda x: x["key"])).alias("block"))
    deeper = F.lead(F.struct("level", "block")).over(Window.partitionBy("message").orderBy("level"))  # levels of one message
    whole = whole.withColumn("deeper", deeper).withColumn("next", F.when(F.col("deeper.level") == F.col("level") + 1, F.col("deeper.block")))
    keys = F.array(F.struct(F.lit(1).alias("kind"), F.col("block").alias("key")),
                   F.struct(F.lit(2).alias("kind"), F.xxhash64("block", F.col("next").isNull(), "next").alias("key")))
    whole = whole.select("message", "sent", "level", F.explode(keys).alias("k")).select("message", "sent", "level", "k.kind", "k.key", F.lit(1).alias("n"))
    return single.select("message", "sent", "level", F.lit(0).alias("kind"), "key", "n").union(whole)


def replies(messages: DataFrame) -> DataFrame:
    """(message, sent, parent, text): whom each message replies to (null: nobody known), without quotes.

    Only earlier messages can be replied to (by ``sent``, then ``message``), so there are no
    cycles. Among equally often quoted ones the latest is taken. Deeper levels count only where the
    levels above give nobody. Messages without level-0 lines
    have an empty text, those with a null text too.
    """
    lines = written(passages(messages), "passages")
    at = lambda: F.struct("sent", "message")
    marked = written(_marked(lines), "marked")
    origin = marked.where("level = 0").groupBy("kind", "key").agg(F.min(at()).alias("origin"))
    quoted = marked.where("level > 0").join(origin, ["kind", "key"]).where(F.col("origin") < at())
    votes = quoted.groupBy("message", "level", "kind", "origin").agg(F.sum("n").alias("n"))
    best = F.max(F.struct(-F.col("level"), "kind", "n", "origin"))
    parent = votes.groupBy("message").agg(best.getField("origin").getField("message").alias("parent"))
    own = lines.where("level = 0").groupBy("message").agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("lines"))
    own = own.select("message", F.trim(F.array_join(F.transform("lines", lambda x: x["body"]), "\n")).alias("text"))
    return (messages.select("message", "sent").join(parent, "message", "left").join(own, "message", "left")
            .select("message", "sent", "parent", F.coalesce("text", F.lit("")).alias("text")))


def conversations(messages: DataFrame) -> DataFrame:
    """``replies`` with ``conversation`` (its first message), ``depth`` and ``path``.

    Sorting a conversation by ``path`` gives reply order: each message right before the replies to
    it, which come as they were sent. Messages of one name count once, the earliest. A path is the hashes of the way down, twelve digits each.
    """
    messages = messages.groupBy("message").agg(F.min(F.struct("sent", "text")).alias("m")).select("message", "m.sent", "m.text")
    tree = written(replies(messages), "replies")
    step = F.concat(F.lpad(F.hex(F.unix_micros("sent") if dict(tree.dtypes)["sent"] == "timestamp" else F.col("sent").cast("long")), 12, "0"),
                    F.substring(F.md5("message"), 1, 4))
    up = written(tree.select("message", F.col("parent").alias("above"), step.alias("path"), F.lit(0).alias("depth"), F.col("message").alias("top"))
                 .withColumn("depth", F.when(F.col("above").isNull(), 0).otherwise(1)), "chains")
    while up.where("above is not null").limit(1).count():
        other = up.select(F.col("message").alias("_m"), F.col("above").alias("_above"), F.col("path").alias("_path"),
                          F.col("depth").alias("_depth"), F.col("top").alias("_top"))
        far = up.join(other, F.col("above") == F.col("_m"), "left")
        new = written(far.select("message", F.col("_above").alias("above"), F.concat(F.coalesce("_path", F.lit("")), "path").alias("path"),
                                 (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_top", "top").alias("top")), "chains")
        dropped(up)
        up = new
    found = up.select("message", F.col("top").alias("conversation"), "depth", "path")
    return tree.join(found, "message").select("conversation", "message", "sent", "parent", "depth", "path", "text")


def as_mail(turns: DataFrame) -> DataFrame:
    """Messages from the turns of conversations, each quoting the turn before it as mail does.

    A turn quotes the whole turn before at level 1 and the one before that at level 2. The first
    turn quotes nothing. Turns with a null conversation or number stand alone. Rows equal in all of
    ``conv_id``, ``turn``, ``role`` and ``text`` are one message, all others messages of their own:
    where conversation and number do not tell them apart, a hash of the row ends the name.
    """
    # A conversation is no group here: neighbours meet by number in an ordinary join.
    whole = F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}))
    own = turns.select("conv_id", "turn", "text", whole.alias("whole"))
    shared = own.groupBy("conv_id", "turn").agg(F.min("whole").alias("least"), F.max("whole").alias("most")).where("least <> most")
    shared = shared.select("conv_id", "turn", F.lit(True).alias("shared"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    plain = F.concat_ws("-", F.lit("m"), number("conv_id"), number("turn"))
    alone = F.col("shared").isNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    name = F.when(alone, plain).otherwise(F.concat_ws("-", plain, "whole"))
    before = lambda n: own.groupBy("conv_id", "turn").agg(F.min("text").alias(f"text{n}")).select("conv_id", (F.col("turn") + n).alias("turn"), f"text{n}")
    quote = lambda c, mark: F.concat(F.regexp_replace(c, "(?m)^", mark), F.lit("\n"))
    rows = own.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left").join(shared, ["conv_id", "turn"], "left")
    text = F.concat(F.coalesce(quote(F.col("text2"), ">> "), F.lit("")), F.coalesce(quote(F.col("text1"), "> "), F.lit("")), F.coalesce("text", F.lit("")))
    return rows.select(name.alias("message"), F.col("turn").cast("long").alias("sent"), "conv_id", "turn", text.alias("text"))
