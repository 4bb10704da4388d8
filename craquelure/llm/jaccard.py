"""Near-copy classes by Jaccard similarity of word n-grams: a parity-sketch join.

A shingle flips one bit of its document's sketch, so the sketches of two documents differ in at
most as many bits as their shingle sets differ in shingles. For sizes a and b a link leaves room
for (a + b)(UNION - SHARED) / (UNION + SHARED) different shingles at most. Sizes are cut into
bands, each with a layout: the sketch of its documents is cut into so many parts that one part at
least of any linked pair is equal (pigeonhole). The set bits of a part are XOR-ed into one hash,
and documents of a band meet where a part's hashes are equal; a document also stands in the band
below if a smaller partner can be there. A layout has more parts than needed, so that a pair has several
equal ones and each document leaves out its weakest parts, those with the fewest bits: less meets
by chance, and never an empty part unless a document has too many of them.

Documents with equal sets are merged first. Then links are looked for in three rounds, and what a
round finds is joined to components:

1. In each group of equal parts every document is verified against the least one: as many pairs
   as rows.
2. Where documents that were not the least one of their group still lie in several components,
   they are compared by whole sketches in bounded blocks. Of the pairs that may be linked a block
   hands over the nearest ones that would join its components: fewer pairs than documents.
3. Pairs that may be linked and still lie in different components are verified one and all. A
   sketch is so wide that those are only pairs next to the bound.

So every pair that shares a part is verified, lies in one component already, or is ruled out by
the bound of its sketches: components are exact, and no group emits its pairs. Shingles and
classes are told apart by 64-bit hashes.

Defined results: a missing text or one without words has an empty set, is linked with nothing and
is its own component; a component takes the smallest id of its rows, or none where no row has one;
repeated rows get the same result, once each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craquelure.llm.common import arrow_bounds, broadcast_if_small, by_batch, checkpointed
from craquelure.llm.simhash import components

WORDS = 4
# two sets link when UNION * intersection >= SHARED * union
SHARED, UNION = 85, 100
# sizes of a band reach from one number to this many times it
BAND = 1.5
# documents a block of a large group has in the second round
BLOCK = 2048
# pairs that are verified against one copy of their common document
CHUNK = 256
# ids of 16 bytes up to which a list of documents is sent to every task
SENT = 500_000

_CACHE = 1 << 17
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_SHIFT = np.uint64(32)


class _Hashes(dict):
    """Hashes of words, kept for the words that come first."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word, 42)
        if len(self) < _CACHE and len(word) < 100:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: dict) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    sums = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        sums += hashes[i : len(hashes) - size + 1 + i] * _ODD[i]
    sums = np.sort(_mixed(sums))
    return sums[np.concatenate([[True], sums[1:] != sums[:-1]])]


def differing(sizes: int) -> int:
    """Shingles that two linked sets may differ in, by the sum of their sizes."""
    return sizes * (UNION - SHARED) // (UNION + SHARED)


@lru_cache(4096)
def layouts(n: int) -> list[tuple[int, int, int]]:
    """(least size of the band, parts, parts that may be left out) of the bands a set of ``n`` shingles stands in."""
    edges = [1]
    while edges[-1] <= n:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    found = []
    for least, beyond in zip(edges[-2::-1], edges[:0:-1]):
        most = beyond - 1
        if most < n and UNION * most < SHARED * n:
            break
        apart = differing(most + most * UNION // SHARED)
        if apart:
            spare = 1 + apart // 4
            found.append((least, apart + 1 + spare, spare))
    return found


def part_keys(u: np.ndarray) -> np.ndarray:
    """What a set is met by: a hash for each part of its sketch in each of its bands."""
    found = []
    for least, parts, spare in layouts(len(u)):
        # hashes are sorted, so those of a part stand together
        part = ((u >> _SHIFT) * np.uint64(parts)) >> _SHIFT
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        bits = np.zeros(parts, np.uint64)
        bits[part[starts]] = np.bitwise_xor.reduceat(u * _ODD[1], starts)
        numbers = np.arange(parts, dtype=np.uint64)
        # of two linked sets more than ``spare`` parts are equal, so one of those stays in both
        sizes = np.bincount(part.astype(np.int64), minlength=parts)
        strong = sizes >= np.partition(sizes, spare)[spare]
        bits, numbers = bits[strong], numbers[strong]
        found.append(_mixed(_mixed(bits) ^ (numbers * _ODD[2] + np.uint64(least))))
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def sketch(u: np.ndarray) -> np.ndarray:
    """The whole sketch in words of 64 bits; half as many are made by an XOR of the halves.

    With 16 bits for each shingle that may differ few of those that do meet in one bit.
    """
    words = 1
    while 4 * words < differing(2 * len(u)):
        words *= 2
    place = (_mixed(u * _ODD[3]) & np.uint64(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return UNION * common >= SHARED * (len(a) + len(b) - common)


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))


def _same() -> Column:
    """A row is the one that ``row_id, row_hash`` name."""
    return (F.col("text_hash") == F.col("row_hash")) & F.col("doc_id").eqNullSafe(F.col("row_id"))


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, class``; equal sets have one class, an empty set has none."""
    known = _Hashes()

    def run(batch: pa.RecordBatch) -> dict:
        import xxhash

        sets = [shingles(t, known) for t in batch.column("text").to_pylist()]
        names = [int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 7)).view(np.int64)) if len(s) else None for s in sets]
        return {"n_shingles": pa.array([len(s) for s in sets], pa.int64()), "class": pa.array(names, pa.int64())}

    return by_batch(_texts(docs), "n_shingles bigint, class bigint", run, keep=("doc_id", "text_hash"))


def _keys(texts: DataFrame) -> DataFrame:
    """``key, class`` for each part of each text's set."""
    known = _Hashes()

    def run(batch: pa.RecordBatch) -> dict:
        import xxhash

        keys, names = [], []
        for text in batch.column("text").to_pylist():
            u = shingles(text, known)
            k = part_keys(u)
            keys.append(k)
            names.append(np.full(len(k), xxhash.xxh64_intdigest(u.tobytes(), 7), np.uint64))
        return {"key": pa.array(np.concatenate(keys)), "class": pa.array(np.concatenate(names).view(np.int64))}

    return by_batch(texts.select("text"), "key bigint, class bigint", run)


def _against_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and class: all classes but the least one of each key, with that one."""
    key = least = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, names = (batch.column(c).to_numpy() for c in ("key", "class"))
        starts = np.concatenate([[keys[0] != key], keys[1:] != keys[:-1]])
        begun = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), -1))
        centre = np.where(begun >= 0, names[begun], 0 if least is None else least)
        again = np.concatenate([[names[0] == last], names[1:] == names[:-1]]) & ~starts
        kept = (names != centre) & ~again
        key, least, last = keys[-1], centre[-1], names[-1]
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array(keys[kept]), "class": pa.array(names[kept]), "centre": pa.array(centre[kept])}
        )


def _sets(texts: DataFrame) -> DataFrame:
    known = _Hashes()

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, known) for t in batch.column("text").to_pylist()]
        return {"hashes": pa.array([s.tobytes() for s in sets], pa.binary())}

    return by_batch(texts.select("class", "text"), "hashes binary", run, keep=("class",))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted so that a document stands before those it is compared with: the linked pairs."""
    head = None
    for batch in batches:
        found = []
        for a, b, hashes in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "hashes"))):
            u = np.frombuffer(hashes, np.uint64)
            if b is None:
                head = u
            elif linked(head, u):
                found.append((a, b))
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: the linked ones of the distinct pairs ``a, b``. A document in many pairs is sent once for every ``CHUNK`` of them."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    each = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"), F.col("b").alias("class"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    heads = many.select("a", F.lit(None).cast("long").alias("b"), chunk, F.col("a").alias("class"))
    wanted, _ = broadcast_if_small(checkpointed(heads.unionByName(each)), SENT)
    rows = sets.join(wanted, "class").select("a", "chunk", "b", "hashes")
    dealt = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
    return dealt.mapInArrow(_verified, "a bigint, b bigint")


def _apart(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of the pairs differ."""
    step = max(1, (1 << 21) // bits.shape[1])
    cuts = range(0, len(i), step)
    far = [np.bitwise_count(bits[i[a : a + step]] ^ bits[j[a : a + step]]).sum(1, dtype=np.int64) for a in cuts]
    return np.concatenate(far) if far else np.zeros(0, np.int64)


def _near(label: np.ndarray, n: np.ndarray, own: np.ndarray, sketches: list[bytes], within: bool):
    """(row, row, share of bits apart): pairs of a block that lie in different components and may be linked."""
    order = np.argsort(n, kind="stable")
    label, n, own = label[order], n[order], own[order]
    words = min(len(s) for s in sketches) // 8
    bits = np.zeros((len(n), words), np.uint64)
    for i, at in enumerate(order.tolist()):
        bits[i] = np.bitwise_xor.reduce(np.frombuffer(sketches[at], np.uint64).reshape(-1, words), axis=0)
    # a sketch folded again bounds as well, only less closely
    rough = np.bitwise_xor.reduce(bits.reshape(len(n), -1, max(1, words // 4)), axis=1)
    step = max(1, (1 << 20) // len(n))
    found = []
    for at in range(0, len(n), step):
        rows = np.arange(at, min(at + step, len(n)))
        until = int(np.searchsorted(n, n[rows[-1]] * UNION // SHARED, side="right"))
        i, j = np.nonzero(
            (rows[:, None] < np.arange(at, until)[None])
            & (label[rows, None] != label[None, at:until])
            & (within | (own[rows, None] != own[None, at:until]))
        )
        i, j = i + at, j + at
        for part in (rough, bits):
            far = _apart(part, i, j)
            some = far <= (n[i] + n[j]) * (UNION - SHARED) // (UNION + SHARED)
            i, j, far = i[some], j[some], far[some]
        found.append((order[i], order[j], far / (n[i] + n[j])))
    return tuple(np.concatenate(c) for c in zip(*found))


def _joining(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a forest over the labels ``a, b``, near ones first: each component takes its nearest."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = ends.reshape(2, -1)
    edges, kept = np.argsort(far, kind="stable"), []
    root = np.arange(len(names))
    while True:
        edges = edges[root[ends[0, edges]] != root[ends[1, edges]]]
        if not len(edges):
            return np.array(kept, np.int64)
        both = root[ends[:, edges]].T.ravel()
        best = edges[np.unique(np.unique(both, return_index=True)[1] // 2)]
        for e in best.tolist():
            x, y = root[ends[0, e]], root[ends[1, e]]
            if x != y:
                root[root == x] = y
                kept.append(e)


def _blocks_compared(joining: bool):
    """From rows sorted by key and pair of blocks: pairs to verify; ``joining``: only a forest of each block."""

    def compared(held: list[pa.RecordBatch], within: bool) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held)
        names, label, n, own = (table.column(c).to_numpy() for c in ("class", "label", "n", "own"))
        if len(np.unique(label)) < 2:
            return None
        i, j, far = _near(label, n, own, table.column("sketch").to_pylist(), within)
        if joining:
            some = _joining(label[i], label[j], far)
            i, j = i[some], j[some]
        a, b = np.minimum(names[i], names[j]), np.maximum(names[i], names[j])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c).to_numpy() for c in ("key", "x", "y")]
            cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in names], axis=0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                here = tuple(int(v[start]) for v in names)
                if here != at and held:
                    made = compared(held, at[1] == at[2])
                    held = []
                    if made is not None:
                        yield made
                at = here
                held.append(batch.slice(start, end - start))
        if held and (made := compared(held, at[1] == at[2])) is not None:
            yield made

    return run


def _across(shared: DataFrame, label: DataFrame, sets: DataFrame, joining: bool) -> DataFrame:
    """``a, b``: pairs of different components that meet in a part beside its least document and may be linked."""
    rows = shared.select("key", "class").join(label, "class", "left")
    rows = rows.select("key", "class", F.coalesce("label", "class").alias("label"))
    # a group whose members meet in another group again is taken once
    groups = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("members"),
        F.min("label").alias("least"),
        F.max("label").alias("most"),
    )
    still = groups.filter("least <> most").groupBy("n", "members").agg(F.min("key").alias("key"))
    still = still.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = checkpointed(rows.join(still, "key"))

    def run(batch: pa.RecordBatch) -> dict:
        sets = [np.frombuffer(h, np.uint64) for h in batch.column("hashes").to_pylist()]
        return {
            "n": pa.array([len(u) for u in sets], pa.int64()),
            "sketch": pa.array([sketch(u).tobytes() for u in sets], pa.binary()),
        }

    wanted, _ = broadcast_if_small(checkpointed(rows.select("class").distinct()), SENT)
    wanted = sets.join(wanted, "class", "left_semi")
    sketches = by_batch(wanted.select("class", "hashes"), "n bigint, sketch binary", run, keep=("class",))
    own = F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    each = rows.join(sketches, "class").withColumn("own", own).withColumn("other", other)
    each = each.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    names = ("key", "x", "y", "class", "label", "n", "own", "sketch")
    dealt = each.select(*names).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(_blocks_compared(joining), "a bigint, b bigint").distinct()


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b``: links between classes of ``rows`` (see ``marked``) that connect what any links connect."""
    texts = _texts(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")
    chosen = rows.filter("class is not null").groupBy("class").agg(least)
    chosen = checkpointed(chosen.select("class", F.col("row.doc_id").alias("row_id"), F.col("row.text_hash").alias("row_hash")))
    both = rows.join(chosen, "class")
    copies = both.filter(~_same()).select(F.col("doc_id").alias("row_id"), F.col("text_hash").alias("row_hash"))
    copies, few = broadcast_if_small(checkpointed(copies.distinct()), SENT)
    # one document of each class: all but a few copies, or those chosen
    firsts = texts.join(copies, _same(), "left_anti") if few else texts.join(chosen, _same(), "left_semi")
    dealt = _keys(firsts).repartition("key").sortWithinPartitions("key", "class")
    shared = checkpointed(dealt.mapInArrow(_against_least, "key bigint, class bigint, centre bigint"))

    pairs = checkpointed(shared.select(F.col("centre").alias("a"), F.col("class").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted, _ = broadcast_if_small(checkpointed(chosen.join(wanted, "class")), SENT)
    sets = checkpointed(_sets(texts.join(wanted, _same())))
    if sets.count() > wanted.count():
        # the same row several times
        sets = checkpointed(sets.dropDuplicates(["class"]))
    found = checkpointed(verify(pairs, sets))
    for joining in (True, False):
        label = components(found).select(F.col("fp").alias("class"), F.col("root").alias("label"))
        more = _across(shared, label, sets, joining).join(pairs, ["a", "b"], "left_anti")
        more = checkpointed(more)
        if not more.isEmpty():
            pairs = pairs.unionByName(more)
            found = checkpointed(found.unionByName(verify(more, sets)))
    return found


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    arrow_bounds(docs.sparkSession)
    rows = checkpointed(marked(docs))
    found = components(links(docs, rows)).withColumnRenamed("fp", "class")
    some = rows.filter("class is not null")
    classes = some.groupBy("class").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(found, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = checkpointed(rooted.join(least, "root").select("class", "component_id"))
    alone = rows.filter("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.join(named, "class").select("doc_id", "n_shingles", "component_id").unionByName(alone)
