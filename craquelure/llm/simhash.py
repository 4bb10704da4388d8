"""SimHash near-dedup: fingerprints, shards of them with vantage-point trees, and components of links.

Two linked fingerprints differ by ``BITS`` at most. Of ``m`` blocks of their bits ``m - BITS`` at
least are then the same, so a fingerprint goes to a shard for each choice of so many blocks, and
linked ones meet in one of them (pigeonhole). ``m`` grows with the number of fingerprints, so a
shard keeps its size where bits are independent.

A vantage point splits fingerprints by their Hamming distance to it. By the triangle inequality
the distances of linked ones to any vantage point differ by ``BITS`` at most, so only those within
``BITS`` below the radius have to stand on both sides. A tree of such points cuts a large shard
where that leaves fewer pairs. Its fingerprints are ordered by distance to another vantage point
and compared exactly with those whose distance the bound allows. A shard gives away a forest of
its links, one row a fingerprint at most, and components are found by alternating large and small
stars over all forests.

Equal fingerprints are merged before the tree, so a group of copies is one point of it.

Defined results: a missing or empty text has fingerprint zero, linked like any other; rows
without an id take the smallest id of their component, or none where no row has one;
repeated rows get the same result, once each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craquelure.llm.common import by_batch, checkpointed, unused, with_text
from craquelure.operators.ordered import in_runs

WORDS = 4
BITS = 4
SEED = 42
# fingerprints a shard should have; as many times that it may have before there are more blocks or a tree
SHARD = 512
FULL = 8
# levels a shard's tree may have, and fingerprints it is grown from
LEVELS = 4
SAMPLE = 16_384
_ROWS = 64


def fingerprint(text: str) -> int:
    """The fingerprint as a signed number."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(WORDS, len(words))
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 14):
        ones += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"fp": pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())}

    texts = with_text(docs, "doc_id").withColumn("text_hash", _text_hash(F.col("text")))
    return by_batch(texts, "fp bigint", run, keep=("doc_id", "text_hash"))


@dataclass
class Tree:
    """A tree in heap order; ``radius`` below 0 marks a leaf."""

    vantage: np.ndarray
    radius: np.ndarray

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, number of the point): every point in its own shard and those it has to be compared in."""
        out, stack = [], [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if self.radius[node] < 0:
                out.append((np.full(len(rows), node, np.int32), rows))
                continue
            far = np.bitwise_count(points[rows] ^ self.vantage[node]).astype(np.int16)
            inside = far <= self.radius[node]
            stack.append((2 * node + 1, rows[inside]))
            stack.append((2 * node + 2, rows[~inside | (far > self.radius[node] - BITS)]))
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def grow(sample: np.ndarray, levels: int, seed: int = 3) -> Tree:
    """A tree of ``levels`` levels, fewer where the sample runs out."""
    random = np.random.default_rng(seed)
    nodes = 2 ** (levels + 1) - 1
    vantage, radius = np.zeros(nodes, np.uint64), np.full(nodes, -1, np.int16)
    stack = [(0, 0, np.unique(sample))]
    while stack:
        node, level, rows = stack.pop()
        if level == levels or len(rows) < 16:
            continue
        best = None
        for candidate in random.choice(rows, 5):
            far = np.bitwise_count(rows ^ candidate).astype(np.int16)
            middle = int(np.median(far))
            inside, border = far <= middle, (far <= middle) & (far > middle - BITS)
            # the larger side, with what the boundary adds to it
            cost = max(inside.sum(), (~inside).sum() + border.sum())
            if not inside.all() and (best is None or cost < best[0]):
                best = (cost, candidate, middle, inside)
        if best is None:
            continue
        _, vantage[node], radius[node], inside = best
        stack += [(2 * node + 1, level + 1, rows[inside]), (2 * node + 2, level + 1, rows[~inside])]
    return Tree(vantage, radius)


def forest(points: np.ndarray) -> np.ndarray:
    """For each of the sorted distinct points the number of its root among those linked to it."""
    root = np.arange(len(points))
    far = np.bitwise_count(points ^ points[:1]).astype(np.int16)
    order = np.argsort(far, kind="stable")
    points, far = points[order], far[order]
    for at in range(0, len(points), _ROWS):
        rows = slice(at, min(at + _ROWS, len(points)))
        # further ones cannot be linked to any row of this block
        until = int(np.searchsorted(far, far[rows.stop - 1] + BITS, side="right"))
        near = np.bitwise_count(points[rows, None] ^ points[None, at:until]) <= BITS
        i, j = np.nonzero(near & (root[rows, None] != root[None, at:until]))
        if len(i):
            pairs = np.unique(np.stack([root[at + i], root[at + j]], 1), axis=0)
            root = _merge(root, pairs)
    out = np.empty(len(points), np.int64)
    out[order] = order[root]
    return out


def _merge(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    parent = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    moved = np.arange(len(root))
    for x in list(parent):
        moved[x] = find(x)
    return moved[root]


def masks(count: int) -> np.ndarray:
    """Bits under each of which two linked fingerprints may be the same, and under one of which they are."""
    wanted = max(0, int(np.ceil(np.log2(max(1, count) / SHARD))))
    if not wanted:
        return np.zeros(1, np.uint64)
    m = BITS + 1
    # longer shards until the next number of blocks, which costs more copies
    while m < 2 * BITS and (m - BITS) * (64 // m) + np.log2(FULL) < wanted:
        m += 1
    taken = -(-wanted // (m - BITS))
    blocks = [sum(1 << int(b) for b in block[:taken]) for block in np.array_split(np.arange(64), m)]
    return np.array([sum(some) for some in combinations(blocks, m - BITS)], np.uint64)


def cut(points: np.ndarray) -> list[np.ndarray]:
    """The points in parts in which all linked ones meet."""
    if len(points) <= FULL * SHARD:
        return [points]
    sample = np.random.default_rng(5).choice(points, min(SAMPLE, len(points)), replace=False)
    tree = grow(sample, min(LEVELS, int(np.ceil(np.log2(len(points) / SHARD)))))
    shard, row = tree.shards(points)
    order = np.argsort(shard, kind="stable")
    parts = np.split(points[row[order]], np.flatnonzero(np.diff(shard[order])) + 1)
    # where most points are close to each other, the boundaries hold them all
    return parts if sum(len(p) ** 2 for p in parts) < len(points) ** 2 else [points]


def links(points: DataFrame) -> DataFrame:
    """``a, b``: links that connect what any links of the distinct ``fp`` connect."""
    same = masks(points.count())

    def route(batch: pa.RecordBatch) -> dict:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        bits = (fp & same[:, None]).ravel().view(np.int64)
        mask = np.repeat(np.arange(len(same), dtype=np.int32), len(fp))
        return {"mask": pa.array(mask), "bits": pa.array(bits), "fp": pa.array(np.tile(fp.view(np.int64), len(same)))}

    def compare(table: pa.Table, starts: np.ndarray) -> pa.Table:
        fp, a, b = table.column("fp").to_numpy().view(np.uint64), [], []
        for shard in np.split(fp, starts[1:]):
            if len(shard) < 2:
                continue
            for part in cut(np.unique(shard)):
                root = forest(part)
                some = np.flatnonzero(root != np.arange(len(part)))
                a.append(part[some])
                b.append(part[root[some]])
        a, b = (np.concatenate([fp[:0], *x]).view(np.int64) for x in (a, b))
        return pa.table({"a": a, "b": b})

    sharded = by_batch(points, "mask int, bits bigint, fp bigint", route)
    return in_runs(sharded, ["mask", "bits"], [], compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``fp, root`` of every linked fingerprint but the roots: large and small stars by turns until nothing moves."""
    # an edge leads from its larger to its smaller end
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges)
    known = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or state == known:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        known = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every larger neighbour now hangs on the least one; next, all smaller ones do
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = (
            least.select("a", F.col("m").alias("b"))
            .unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        edges = checkpointed(edges)


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` of every row; ``root`` names the component."""
    marked = checkpointed(fingerprints(docs))
    points = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(points.select("fp")))
    rooted = points.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest ``doc_id``, columns as they were.

    Rows without an id come last; among rows that share the id the hash of the text decides.
    """
    each = groups(docs).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "rows")
    kept = checkpointed(each.groupBy("root").agg(F.min(order).alias("kept")).select("kept.*"))
    names = unused(docs.columns, "id", "hash", "rows")
    kept = kept.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "text_hash", "rows"), names)))
    of_id, of_hash, rows = (F.col(n) for n in names)
    same = docs["doc_id"].eqNullSafe(of_id) & (_text_hash(docs["text"]) == of_hash)
    if kept.filter(rows > 1).isEmpty():
        return docs.join(kept, same, "left_semi")
    once = docs.join(kept.filter(rows == 1), same, "left_semi")
    # the same row several times
    repeated = docs.join(kept.filter(rows > 1), same, "left_semi")
    return once.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
