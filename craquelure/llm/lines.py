"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line goes if an equal one, or one within an edit distance of one character, stands
earlier in the corpus; blank lines stay, and lines of fewer than ``LEAST`` characters are
only compared for equality. Order is that of documents by id, then of lines.

All deletions of every line would be as many rows as there are characters. One edit leaves
everything outside one block of the line as it is, so lines are first cut into blocks and
each emits a hash of what is outside each block; only where two different lines share such
a hash are the blocks cut again, into short ones, and only where they share those are the
deletion variants of the short block emitted. Two lines that differ by a substitution share
a variant at the same place, two that differ by an insertion share the shorter one itself.
Within a group of equal variants everything is within the bound of its earliest line, so a
group needs its least line and no pairs; the edit distance to that line is verified. Groups
are only aggregated, never ordered, so a template of which one block varies may be of any size.

The hashes shared on the first level go to the tasks only up to a checked number; beyond
it they are joined by a shuffle, and the lines that are hit are fetched afterwards.

Defined results: a missing text stays missing; a text whose lines all go is empty;
documents without an id come last in order; rows that share a ``doc_id`` are told apart by
a hash of their texts, and rows repeated with the same text are one document, each losing
the same lines; other columns go through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craquelure.llm.common import broadcast_if_small, checkpointed, unused

LEAST = 16
EDITS = 1
BLOCK, SHORT_BLOCK = 256, 16
# a shared hash is 8 bytes, the first place of a repeated line below 50
HASHES_SENT = 2_000_000
COPIES_SENT = 1_000_000
SALTS = 16
_BLANKS = " \t\n\x0b\f\r"
_NO_ID = (1 << 63) - 1


def _place() -> list[Column]:
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
    ]


def lines(docs: DataFrame) -> DataFrame:
    """``at`` (document, hash of its text, number) and ``line`` of every line that is not blank."""
    split = docs.filter(F.col("text").isNotNull()).select(
        *_place(), F.posexplode(F.split("text", "\n")).alias("number", "line")
    )
    filled = split.filter(F.btrim("line", F.lit(_BLANKS)) != "")
    return filled.select(F.struct("doc", "text_hash", "number").alias("at"), "line")


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """What each block of ``body`` leaves outside, hashed into ``key``, and the block.

    ``longer`` is the length of the longer of two bodies that are to be compared; a body
    is as long or one character shorter, and its blocks are counted from both ends.
    """
    blocks = F.greatest(F.lit(2), F.ceil(F.col("longer") / size).cast("int"))
    cut = rows.withColumn("blocks", blocks).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    edge = lambda i: F.floor(i * F.col("longer") / F.col("blocks")).cast("int")
    cut = cut.withColumn("first", edge(F.col("block"))).withColumn("last", edge(F.col("block") + 1))
    missing = F.col("longer") - F.length("body")
    before = F.substring("body", F.lit(1), F.col("first"))
    after = F.expr("substring(body, last - (longer - length(body)) + 1)")
    return cut.select(
        F.xxhash64("key", "longer", "block", F.xxhash64(before), F.xxhash64(after)).alias("key"),
        (F.col("last") - F.col("first")).alias("longer"),
        F.substring("body", F.col("first") + 1, F.col("last") - F.col("first") - missing).alias("body"),
        "at",
    )


def _halves(found: DataFrame) -> DataFrame:
    """``key, other, at, line`` and the block's place for lines of two blocks: :func:`_pieces` with every character hashed
    once or twice. ``other`` tells different lines of a key apart.

    The halves for a partner of the same length and for one a character longer differ on one side only.
    """
    d = found.select("at", "line", F.length("line").alias("n"))
    d = d.filter((F.col("n") >= LEAST) & (F.col("n") < 2 * BLOCK)).withColumn("half", F.expr("cast(n div 2 as int)"))
    even = F.col("n") % 2 == 0
    third = F.when(even, F.expr("substring(line, half, half + 1)")).otherwise(F.expr("substring(line, 1, half + 1)"))
    d = d.select(
        "at",
        "line",
        "n",
        F.xxhash64(F.expr("substring(line, 1, half)")).alias("head"),
        F.xxhash64(F.expr("substring(line, half + 1)")).alias("tail"),
        F.xxhash64(third).alias("third"),
    )
    none = F.xxhash64(F.lit(""))
    longer_head, longer_tail = F.when(even, F.col("head")).otherwise(F.col("third")), F.when(even, F.col("third")).otherwise(F.col("tail"))

    def without(longer: Column, block: int, before: Column, after: Column) -> Column:
        key = F.xxhash64(F.lit(0).cast("long"), longer, F.lit(block), before, after)
        return F.struct(key.alias("key"), longer.alias("longer"), F.lit(block).alias("block"))

    n, more = F.col("n"), F.col("n") + 1
    each = F.array(
        without(n, 0, none, F.col("tail")),
        without(n, 1, F.col("head"), none),
        without(more, 0, none, longer_tail),
        without(more, 1, longer_head, none),
    )
    d = d.select("at", "line", "n", F.xxhash64("head", "tail").alias("other"), F.explode(each).alias("piece"))
    return d.select("at", "line", "n", "other", "piece.*")


def _bodies(halves: DataFrame) -> DataFrame:
    """``key, longer, body, at`` of blocks as :func:`_pieces` has them."""
    edge = F.expr("cast(longer div 2 as int)")
    first = F.col("block") == 0
    size = F.when(first, edge).otherwise(F.col("longer") - edge)
    start = F.when(first, F.lit(1)).otherwise(edge + 1)
    body = F.substring("line", start, size - (F.col("longer") - F.col("n")))
    return halves.select("key", size.alias("longer"), body.alias("body"), "at")


def _shared(pieces: DataFrame, other: Column | None = None) -> DataFrame:
    """Keys under which different bodies stand."""
    body = F.xxhash64("body") if other is None else other
    span = pieces.groupBy("key").agg(F.min(body).alias("low"), F.max(body).alias("high"))
    return span.filter("low < high").select("key")


def _earliest(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("key", "longer", "body").agg(F.min("at").alias("at"))


def near_copies(found: DataFrame, *, sent: int = HASHES_SENT) -> DataFrame:
    """``at`` of the first place of every line that has an earlier one within the edit distance."""
    halves = _halves(found)
    whole = found.filter(F.length("line") >= 2 * BLOCK).select(
        F.lit(0).cast("long").alias("key"),
        F.explode(F.array(F.length("line"), F.length("line") + 1)).alias("longer"),
        F.col("line").alias("body"),
        "at",
    )
    blocks = _pieces(whole, BLOCK)
    hashes = halves.select("key", "other").unionByName(blocks.select("key", F.xxhash64("body").alias("other")))
    # both results are far smaller than what they are found in, and are read several times
    shared, few = broadcast_if_small(checkpointed(_shared(hashes, F.col("other"))), sent)
    hit = halves.join(shared, "key", "left_semi")
    if not few:
        # lines do not cross the shuffle of their hashes
        hit = halves.drop("line").join(shared, "key", "left_semi").join(found, "at")
    outer = _bodies(hit).unionByName(blocks.join(shared, "key", "left_semi"))
    inner = _pieces(checkpointed(_earliest(outer)), SHORT_BLOCK)
    bodies = checkpointed(_earliest(inner.join(_shared(inner), "key", "left_semi")))

    full = bodies.filter(F.length("body") == F.col("longer"))
    gaps = full.select("key", "at", "body", F.explode(F.sequence(F.lit(1), F.length("body"))).alias("gap"))
    deleted = F.concat(F.substring("body", F.lit(1), F.col("gap") - 1), F.expr("substring(body, gap + 1)"))
    same, lacking, whole_body = F.lit("="), F.lit("-"), F.lit("o")
    variants = gaps.select("key", "at", F.explode(F.array(
        F.struct(same.alias("role"), F.xxhash64("key", "gap", deleted).alias("variant")),
        F.struct(lacking.alias("role"), F.xxhash64("key", deleted).alias("variant")),
    )).alias("v")).select("key", "at", "v.*")
    shorter = bodies.filter(F.length("body") < F.col("longer")).select(
        "key", "at", whole_body.alias("role"), F.xxhash64("key", "body").alias("variant")
    )
    variants = variants.unionByName(shorter)
    # the earliest of those that share a variant: substitutions among themselves, deletions with the whole
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("at")))
    least = variants.groupBy("key", "variant").agg(of("=").alias("eq"), of("-").alias("minus"), of("o").alias("whole"))
    least = least.filter("eq is not null or (minus is not null and whole is not null)")
    partner = F.when(F.col("role") == "=", F.col("eq")).when(F.col("role") == "-", F.col("whole")).otherwise(F.col("minus"))
    pairs = (
        variants.join(least, ["key", "variant"])
        .select("key", "at", partner.alias("other"))
        .filter("other < at")
        .distinct()
    )
    others = bodies.select("key", F.col("at").alias("other"), F.col("body").alias("other_body"))
    verified = (
        pairs.join(bodies.select("key", "at", "body"), ["key", "at"])
        .join(others, ["key", "other"])
        .filter(F.levenshtein("body", "other_body", EDITS) >= 0)
    )
    return verified.select("at").distinct()


def copies(found: DataFrame, *, sent: int = COPIES_SENT) -> DataFrame:
    """``at`` of every line that equals an earlier one.

    First places that are too many to send are joined by a shuffle, salted so that one line
    that stands everywhere spreads over several tasks.
    """
    hashed = found.select("at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    first = hashed.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    first, small = broadcast_if_small(checkpointed(first.filter("first < last").drop("last")), sent)
    keys = ["h1", "h2"]
    if not small:
        hashed = hashed.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)))
        first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        keys.append("salt")
    return hashed.join(first, keys).filter("at > first").select("at")


def dropped(docs: DataFrame) -> DataFrame:
    """``doc, text_hash`` and the numbers of the lines that go, ``exact`` and ``near``."""
    found = lines(docs)
    every = copies(found).withColumn("near", F.lit(False)).unionByName(
        near_copies(found).withColumn("near", F.lit(True))
    )
    number = F.col("at.number")
    return every.groupBy("at.doc", "at.text_hash").agg(
        F.collect_set(F.when(~F.col("near"), number)).alias("exact"),
        F.collect_set(F.when(F.col("near"), number)).alias("near"),
    )


def dedup(docs: DataFrame, count: bool = False) -> DataFrame:
    """``docs`` with the remaining lines as ``text``; ``count`` adds the numbers of lines and of those that went."""
    names = unused(docs.columns, "doc", "hash", "exact", "near")
    gone = dropped(docs).toDF(*names)
    of_doc, of_hash, exact, near = (F.col(n) for n in names)
    doc, text_hash = _place()
    rows = docs.join(gone, (doc == of_doc) & (text_hash == of_hash), "left")
    split, out = F.split("text", "\n"), F.array_union(exact, near)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), out)
    # the outer transform holds the lines, so that they are not split again for each of them
    joined = lambda parts: F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    text = F.get(F.transform(F.array(split), joined), 0)
    columns = {"text": F.when(of_doc.isNull(), F.col("text")).otherwise(text)}
    counts = []
    if count:
        breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
        counts = [
            F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size(exact), F.lit(0)).cast("long").alias("n_exact"),
            F.coalesce(F.size(near), F.lit(0)).cast("long").alias("n_near"),
        ]
    return rows.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns), *counts)
