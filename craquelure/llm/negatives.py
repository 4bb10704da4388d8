"""Hard-negative mining by a secondary-sort shuffle.

Every anchor has windows: each of its first ``positives`` rows of the same label opens one, from
the positive's score down to ``low / high`` of it, and the first ``negatives`` rows of other
labels in it are its hard negatives. Scores are packed into keys (anchor, descending score,
positives first, id), dealt by anchor and sorted within the partitions, the DataFrame form of
``repartitionAndSortWithinPartitions``; one pass over the sorted keys opens a window at each
positive and hands out negatives until it is full or left. It holds the open windows of one
anchor and nothing else.

Anchors meet all rows in blocks (``ANCHORS`` by ``ROWS``), one matrix product a block. A block
ships per anchor only what can be among the first rows of the whole: its first positives, and,
when the positives of all blocks are known, the first negatives of each of their windows. Ties
are cut in the order of the result, so copies of one vector, however many, add nothing.

Defined results: rows without an id, a label or a vector, with a missing or non-finite
component, or whose squared length does not fit 62 bits take no part; a row given several times
counts once, and of different rows with one id the least by label and vector counts; vectors of
different lengths never meet; an anchor without positives or a positive without negatives has no
rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craquelure.llm.common import arrow_bounds, checkpointed

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# a negative's score is at least LOW / HIGH of the positive's, and not above it
LOW, HIGH = 80, 100
# anchors and rows of a block
ANCHORS = 512
ROWS = 8192

_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, q``: the rows that take part, their components as integers."""
    whole = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    q = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    length = F.aggregate("q", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    given = vectors.select("vec_id", "label", "embedding").dropna().filter(whole)
    given = given.select("vec_id", "label", q.alias("q")).filter(length < 2.0**62)
    return given.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.*")


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    # sums may wrap on the way; the result fits
    return a @ b.T


def first(score: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest scores of each row, ties by the smaller column."""
    held = np.where(among, score, _NONE)
    if score.shape[1] > k:
        least = np.partition(held, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        among = among & (held >= least[:, None])
    row, column = np.nonzero(among)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


def _vectors(table: pa.Table) -> dict[int, dict[str, np.ndarray]]:
    """The rows of each vector length, by id."""
    table = table.combine_chunks().sort_by("vec_id")
    q = table.column("q").combine_chunks()
    q = q.chunk(0) if isinstance(q, pa.ChunkedArray) else q
    ends = q.offsets.to_numpy()
    lengths, flat = np.diff(ends), q.values.to_numpy()
    out = {}
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        at = ends[:-1][rows, None] + np.arange(d)
        out[d] = {"q": flat[at], "row": rows} | {c: table.column(c).to_numpy()[rows] for c in ("vec_id", "label")}
        if "bounds" in table.column_names:
            out[d]["bounds"] = [table.column("bounds")[r].as_py() for r in rows.tolist()]
    return out


def _met(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """Of a block each anchor's first ``k`` positives, or with ``bounds`` the first ``k`` negatives of each window."""
    made = []
    given = _vectors(rows) if rows.num_rows and anchors.num_rows else {}
    for d, a in (_vectors(anchors) if given else {}).items():
        if d not in given:
            continue
        b = given[d]
        score = scores(a["q"], b["q"])
        same = a["label"][:, None] == b["label"][None]
        if "bounds" not in a:
            i, j = first(score, same & (a["vec_id"][:, None] != b["vec_id"][None]), k)
        else:
            hits = []
            for w in range(max((len(x) for x in a["bounds"]), default=0)):
                # an anchor with fewer windows gets an empty one
                span = np.array([(x[w]["least"], x[w]["most"]) if w < len(x) else (1, 0) for x in a["bounds"]], np.int64)
                hits.append(first(score, ~same & (score >= span[:, :1]) & (score <= span[:, 1:]), k))
            if not hits:
                continue
            i, j = np.unique(np.concatenate([np.stack(h, 1) for h in hits]), axis=0).T
        made.append((a["vec_id"][i], score[i, j], b["vec_id"][j]))
    columns = [np.concatenate(c) if made else np.zeros(0, np.int64) for c in (zip(*made) if made else [()] * 3)]
    return pa.table(dict(zip(("anchor_id", "score", "vec_id"), (pa.array(c, pa.int64()) for c in columns))))


def _blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int) -> DataFrame:
    across, down = -(-n_rows // ROWS), -(-n_anchors // ANCHORS)
    each = rows.withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int"))
    each = each.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    every = anchors.withColumn("a", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int"))
    every = every.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    # columns of their own: both sides come from one table
    every = every.select(*(F.col(c).alias(c) for c in every.columns))
    both = each.groupBy("a", "r").cogroup(every.groupBy("a", "r"))
    return both.applyInArrow(lambda x, y: _met(x, y, k), "anchor_id long, score long, vec_id long")


def _windows(positives: int, negatives: int, low: int, high: int):
    """The pass over sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, opened, left = None, [], 0
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("anchor_id", "score", "positive", "vec_id"))
            for a, score, positive, row in zip(*columns):
                if a != anchor:
                    anchor, opened, left = a, [], positives
                if positive:
                    if left:
                        opened.append([row, score, 0])
                        left -= 1
                    continue
                opened = [w for w in opened if w[2] < negatives and low * w[1] <= high * score]
                for w in opened:
                    w[2] += 1
                    out.append((a, w[0], w[2], row, w[1], score))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            values = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names)

    return run


def mine(
    vectors: DataFrame,
    anchor: Column,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every window.

    ``anchor`` says of ``vec_id`` and ``label`` which rows are anchors.
    """
    arrow_bounds(vectors.sparkSession)
    schema = (
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    rows = checkpointed(quantised(vectors, scale))
    anchors = rows.filter(anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        return vectors.sparkSession.createDataFrame([], schema)
    near = checkpointed(_blocks(rows, anchors, n_rows, n_anchors, positives))
    # each anchor gets the windows of the first positives of all blocks; those beyond the first ones are left out
    kept = F.slice(F.sort_array(F.collect_set("score"), asc=False), 1, positives)
    part = f"(cast(s as decimal(20, 0)) * {low})"
    least = f"({part} div {high}) + if({part} % {high} > 0, 1, 0)"
    low_high = F.expr(f"transform(scores, s -> struct(cast({least} as long) as least, s as most))")
    first_of = _least(near, positives).groupBy("anchor_id").agg(kept.alias("scores"))
    bounds = first_of.select(F.col("anchor_id").alias("vec_id"), low_high.alias("bounds"))
    far = _blocks(rows, anchors.join(bounds, "vec_id"), n_rows, n_anchors, negatives)
    keys = near.withColumn("positive", F.lit(True)).unionByName(far.withColumn("positive", F.lit(False)))
    dealt = keys.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), F.desc("positive"), "vec_id")
    return dealt.mapInArrow(_windows(positives, negatives, low, high), schema)


def _least(near: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor."""
    from pyspark.sql import Window

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= k).drop("number")
