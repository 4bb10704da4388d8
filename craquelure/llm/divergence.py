"""Source divergence audit: how far the term shares of the sources of a language lie apart.

The count matrix of a language has a row for each source and a column for each kept term. It is
cut into tiles of ``ROWS`` sources by about ``COLUMNS`` terms; a tile is stored as a k-squared
tree (``K`` by ``K`` quadrants a node, a bit for each quadrant that holds a count). Two tiles of
the same terms are traversed jointly, for all pairs of their sources at once: a quadrant without
counts on both sides is one product of its width and the price of two zeros, whatever its size,
and only quadrants with a count on a side are followed down to their cells. The tile of a source
block is compared in the same way with the row of the whole language, which gives the terms a
source has too much of.

Counts are gathered within each task before they are shuffled, so a hot source or language
costs no more than its different terms. No tile depends on the size of a group.

Defined results: a missing text, language or source counts as the empty one; repeated rows count
as often as they stand there; a group without kept terms has pairs, all of whose shares are
equal, and no terms; a language with one source has no pairs; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craquelure.llm.common import arrow_bounds, broadcast_if_small, checkpointed

LEAST_DOCS = 10
TOP = 10
K = 4
ROWS = 64
COLUMNS = 256
# different terms a task gathers before it hands them on
GATHERED = 400_000
# groups or languages up to which they are sent to every task; a row has about 100 bytes
SENT = 100_000

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_BREAKS = bytes(b if b in _LETTERS else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_BREAKS).split()


def gathered(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents; the row without a term says that the group occurs."""
    arrow_bounds(docs.sparkSession)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            columns = (batch.column(c) for c in ("lang", "source", "text"))
            for lang, source, text in zip(*(c.to_pylist() for c in columns)):
                n, docs = found.setdefault((lang, source), (Counter(), Counter({None: 0})))
                words, before = terms(text), len(n)
                n.update(words)
                docs.update(set(words))
                docs[None] += 1
                size += len(n) - before
                if size + len(found) >= GATHERED:
                    yield from _rows(found)
                    found, size = {}, 0
        yield from _rows(found)

    schema = "lang string, source string, term string, n bigint, docs bigint"
    # dealt by term, so that adding up, counting a term's documents and dropping rare ones is one shuffle
    dealt = texts.mapInArrow(run, schema).repartition("lang", "term")
    return dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rows(found: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in found.items():
        words = list(docs)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang] * len(words), pa.string()),
                "source": pa.array([source] * len(words), pa.string()),
                "term": pa.array([None if w is None else w.decode("utf-8", "surrogatepass") for w in words], pa.string()),
                "n": pa.array([n[w] for w in words], pa.int64()),
                "docs": pa.array(list(docs.values()), pa.int64()),
            }
        )


@dataclass
class Tree:
    """A k-squared tree. ``below[l][node * K * K + q]`` is the child's number on the next level, -1 for an empty quadrant.

    Children are numbered by the rank of their bit; those of the last level are the cells, whose
    counts are in ``values``.
    """

    below: list[np.ndarray]
    values: np.ndarray


def tree(row: np.ndarray, column: np.ndarray, values: np.ndarray, levels: int) -> Tree:
    path = np.zeros(len(row), np.int64)
    for level in range(levels - 1, -1, -1):
        side = K**level
        path = path * K * K + row // side % K * K + column // side % K
    order = np.argsort(path)
    path = path[order]
    below, nodes = [], np.zeros(1, np.int64)
    for level in range(levels - 1, -1, -1):
        children = np.unique(path // (K * K) ** level)
        child = np.full(max(1, len(nodes)) * K * K, -1, np.int32)
        child[np.searchsorted(nodes, children // (K * K)) * K * K + children % (K * K)] = np.arange(len(children))
        below.append(child)
        nodes = children
    return Tree(below, values[order])


def together(a: Tree, b: Tree, shape: tuple[int, int, int], half: bool) -> tuple[np.ndarray, tuple]:
    """Joint traversal for all pairs of a row of ``a`` and a row of ``b``; ``half``: the row of ``a`` comes first.

    Returns for each pair the number of columns in which both are empty, and for each other cell
    (row of a, row of b, column, count in a, count in b).
    """
    rows_a, rows_b, columns = shape
    empty = np.zeros((rows_a, rows_b), np.int64)
    step = np.arange(K, dtype=np.int32)
    x, y, z = (v.ravel()[None] for v in np.meshgrid(step, step, step, indexing="ij"))
    at = [np.zeros(1, np.int32)] * 5  # node of a, node of b, row of a, row of b, column, in quadrants
    levels = len(a.below)
    for level in range(levels):
        side = K ** (levels - level - 1)
        node_a, node_b, row_a, row_b, column = (v[:, None] for v in at)
        row_a, row_b, column = row_a * K + x, row_b * K + y, column * K + z
        inside = (row_a * side < rows_a) & (row_b * side < rows_b) & (column * side < columns)
        if half:
            inside &= (row_a < row_b) if side == 1 else (row_a <= row_b)
        node_a = np.where(node_a < 0, -1, a.below[level][np.maximum(node_a, 0) * K * K + x * K + z])[inside]
        node_b = np.where(node_b < 0, -1, b.below[level][np.maximum(node_b, 0) * K * K + y * K + z])[inside]
        row_a, row_b, column = row_a[inside], row_b[inside], column[inside]
        both = (node_a < 0) & (node_b < 0)
        if both.any():
            wide = np.zeros((-(-rows_a // side), -(-rows_b // side)), np.int64)
            np.add.at(wide, (row_a[both], row_b[both]), np.minimum(side, columns - column[both] * side))
            empty += np.kron(wide, np.ones((side, side), np.int64))[:rows_a, :rows_b]
        at = [v[~both] for v in (node_a, node_b, row_a, row_b, column)]
    node_a, node_b, row_a, row_b, column = at
    counts = (np.where(n < 0, 0, t.values[n]) if len(t.values) else np.zeros(len(n), np.int64) for n, t in ((node_a, a), (node_b, b)))
    return empty, (row_a, row_b, column, *counts)


def share(n: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 (n + 2) / (total + 2 v)) in steps that stay within 64 bits."""
    whole = total + 2 * v
    high, rest = np.divmod((n + 2) * 10_000, whole)
    return 1 + high * 100_000 + rest * 100_000 // whole


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(first: dict, second: dict | None, lang: dict, v: int, total: int, top: int) -> list[dict]:
    """Sums over a tile's columns for the pairs of sources, and each source's terms furthest above the language."""
    columns = len(lang["n"])
    other = second or first
    sides = (len(first["n"]), len(other["n"]), columns)
    levels = 1
    while K**levels < max(sides):
        levels += 1
    a = tree(first["row"], first["column"], first["count"], levels)
    b = tree(second["row"], second["column"], second["count"], levels) if second else a
    empty, (row_a, row_b, _, n_a, n_b) = together(a, b, sides, half=second is None)
    zero_a, zero_b = (share(np.zeros(len(t), np.int64), t, v) for t in (first["n"], other["n"]))
    sums = empty * gap(zero_a[:, None], zero_b[None, :])
    np.add.at(sums, (row_a, row_b), gap(share(n_a, first["n"][row_a], v), share(n_b, other["n"][row_b], v)))
    i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1)) if second is None else np.indices(sums.shape).reshape(2, -1)
    made = [
        {"source": first["label"][i], "other": other["label"][j], "value": sums[i, j]},
        {"source": other["label"][j], "other": first["label"][i], "value": sums[i, j]},
    ]
    if second is None:
        row = np.zeros(columns, np.int64)
        c = tree(row, np.arange(columns), lang["n"], levels)
        _, (row_a, _, column, n_a, n_c) = together(a, c, (sides[0], 1, columns), half=False)
        p, q = share(n_a, first["n"][row_a], v), share(n_c, np.int64(total), v)
        above = (n_a > 0) & (p > q)
        row_a, column, value = row_a[above], column[above], gap(p, q)[above]
        order = np.lexsort((column, -value, row_a))
        row_a, column, value = row_a[order], column[order], value[order]
        best = np.arange(len(row_a)) - np.searchsorted(row_a, row_a) < top
        made.append({"source": first["label"][row_a[best]], "term": lang["label"][column[best]], "value": value[best]})
    return made


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    i, j = key[2].as_py(), key[3].as_py()
    kind, row, column, n = (table.column(c).to_numpy() for c in ("kind", "row", "column", "n"))
    label = np.array(table.column("label").to_pylist(), object)
    block = table.column("block").to_numpy()

    def side(at: int) -> dict:
        heads, cells = np.flatnonzero((kind == 0) & (block == at)), (kind == 1) & (block == at)
        heads = heads[np.argsort(row[heads])]
        least = row[heads[0]]
        return {
            "n": n[heads],
            "label": label[heads],
            "row": row[cells] - least,
            "column": column[cells],
            "count": n[cells],
        }

    heads = np.flatnonzero(kind == 2)
    heads = heads[np.argsort(column[heads])]
    v, total = (int(table.column(c)[0].as_py()) for c in ("v", "total"))
    lang = {"n": n[heads], "label": label[heads]}
    parts = _compare(side(i), side(j) if i != j else None, lang, v, total, TOP)
    names = {"source": pa.string(), "other": pa.string(), "term": pa.string(), "value": pa.int64()}
    made = [
        pa.table({c: pa.array(p[c], t) if c in p else pa.nulls(len(p["value"]), t) for c, t in names.items()}) for p in parts
    ]
    made = pa.concat_tables(made)
    return made.add_column(0, "lang", pa.array([key[0].as_py()] * made.num_rows, pa.string()))


def audit(docs: DataFrame, *, rows: int = ROWS, columns: int = COLUMNS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, part, item, value, rank``: the other sources by distance, and the ``TOP`` terms a source is above its language in."""
    of_term = F.sum("docs").over(Window.partitionBy("lang", "term"))
    cells = gathered(docs).withColumn("docs", of_term).filter((F.col("docs") >= least_docs) | F.col("term").isNull())
    cells = checkpointed(cells.drop("docs"))
    kept = cells.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total"))
    used = cells.filter("term is not null").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    found = cells.filter("term is null").select("lang", "source")
    within = Window.partitionBy("lang")
    groups = found.join(langs, "lang", "left").join(used, ["lang", "source"], "left")
    groups = checkpointed(
        groups.select(
            "lang",
            "source",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("v", F.lit(0)).alias("v"),
            F.coalesce("total", F.lit(0)).alias("total"),
            F.ceil(F.col("v") / columns).cast("int").alias("stripes"),
            (F.row_number().over(within.orderBy("source")) - 1).alias("row"),
            F.ceil(F.count(F.lit(1)).over(within) / rows).cast("int").alias("blocks"),
        ).withColumn("block", F.floor(F.col("row") / rows).cast("int"))
    )
    langs, _ = broadcast_if_small(groups.filter("v > 0").select("lang", "v", "total", "stripes", "blocks").distinct(), SENT)
    named, _ = broadcast_if_small(groups.filter("v > 0").select("lang", "source", "row", "block"), SENT)

    stripe = F.pmod(F.xxhash64("term"), F.col("stripes").cast("long")).cast("int")
    numbered = kept.join(langs, "lang").withColumn("stripe", stripe)
    place = F.row_number().over(Window.partitionBy("lang", "stripe").orderBy("term")) - 1
    numbered = checkpointed(numbered.withColumn("column", place))

    def rows_of(df: DataFrame, kind: int, **given: Column) -> DataFrame:
        names = {"row": "int", "column": "int", "n": "long", "block": "int"}
        made = [given.get(c, F.lit(-1)).cast(t).alias(c) for c, t in names.items()]
        made.append(given.get("label", F.lit(None)).cast("string").alias("label"))
        return df.select("lang", "stripe", "v", "total", "blocks", F.lit(kind).alias("kind"), *made)

    col = F.col
    every = groups.filter("v > 0").withColumn("stripe", F.explode(F.sequence(F.lit(0), col("stripes") - 1)))
    heads = rows_of(every, 0, row=col("row"), label=col("source"), n=col("n"), block=col("block"))
    counted = cells.join(numbered.drop("n"), ["lang", "term"]).join(named, ["lang", "source"])
    counts = rows_of(counted, 1, row=col("row"), column=col("column"), n=col("n"), block=col("block"))
    columns_of = rows_of(numbered, 2, column=col("column"), label=col("term"), n=col("n"))
    # a block of sources meets every other one, the columns of the language stand in each of those tiles
    everywhere = F.sequence(F.lit(0), col("blocks") - 1)
    met = F.transform(everywhere, lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    pairs = F.flatten(
        F.transform(everywhere, lambda x: F.transform(F.sequence(x, col("blocks") - 1), lambda y: F.struct(x.alias("i"), y.alias("j"))))
    )
    tiles = heads.unionByName(counts).withColumn("at", F.explode(met))
    tiles = tiles.unionByName(columns_of.withColumn("at", F.explode(pairs))).select("*", "at.i", "at.j").drop("at", "blocks")
    arrow_bounds(docs.sparkSession)
    schema = "lang string, source string, other string, term string, value bigint"
    made = checkpointed(tiles.groupBy("lang", "stripe", "i", "j").applyInArrow(_tile, schema))

    apart = made.filter("term is null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    # without kept terms there is no tile, and nothing to add up
    bare = groups.filter("v = 0").select("lang", "source")
    alike = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    apart = apart.unionByName(alike.withColumn("value", F.lit(0).cast("long"))).withColumn("part", F.lit("pair"))
    above = made.filter("term is not null").select("lang", "source", F.col("term").alias("item"), "value")
    above = above.withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    names = ("lang", "source", "part", "item", "value", "rank")
    above = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return apart.withColumn("rank", F.row_number().over(order)).select(*names).unionByName(above.select(*names))
