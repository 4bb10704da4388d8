"""Quality rules: statistics of a text, and an isolation forest over them.

Every labelled row counts. Every other row of each label grows the forest: it is dealt to one
of the trees, to more of them where a tree would get fewer than ``SUBSAMPLE`` rows. All trees
grow by a level at a time, out of the ranges of their open nodes. A split takes a ratio the more
often, the better that ratio alone tells the two labels apart, so that what is only unusual (a
short text, a telephone number) weighs less than what makes a text bad. The cut through the
anomaly scores is the one of the best balanced accuracy on the other rows. The driver sees the
ranges of the open nodes and the counts of the ``STEPS`` possible scores, whatever the number
of rows.

Defined results: a missing or empty text has no words and fails the base rule; a missing
``doc_id`` is kept; repeated rows are judged alike, once each; other columns are ignored;
without labels of both kinds there is no forest and the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from craquelure.llm.common import broadcast_if_small, by_batch, checkpointed, with_text
from craquelure.operators.ordered import cuts_of, part_of, quantiles

TREES, SUBSAMPLE = 100, 256
# a score is a multiple of 1 / STEPS
STEPS = 100_000
# labels that may go to every task; beyond them the ratios are shuffled, never the texts
LABELS_SENT = 1 << 20
# different values of a ratio that are counted together
VALUES = 1 << 16
# rows of a label that are numbered together
PART_ROWS = 4096
# how often a ratio without any bearing on the labels is split by, against 1 for one that tells them apart
LEAST_WEIGHT = 0.001
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
FEATURES = 10


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words which the text has at least twice."""
    windows = len(words) - WINDOW + 1
    if windows < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    many = len(seen)
    key = ids[:windows]
    bound = many
    for k in range(1, WINDOW):
        if bound * many >= 1 << 62:
            # rank what there is so far: the number stays exact
            key = np.unique(key, return_inverse=True)[1]
            bound = windows
        key = key * many + ids[k : windows + k]
        bound *= many
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.searchsorted(twice, key)
    at[at == len(twice)] = 0
    start = np.flatnonzero(twice[at] == key)
    change = np.zeros(len(words) + 1, np.int64)
    change[start] += 1
    change[start + WINDOW] -= 1
    return int((np.cumsum(change) > 0).sum())


def statistics_of(text: str) -> tuple[list[int], list[float]]:
    """The five counts of the rules, and the ratios that the forest looks at."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    blanks = int(at[32] + at[9:14].sum())
    chars = len(text) - blanks
    symbols = int(at[list(SYMBOLS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    n = max(1, len(words))
    upper, lower, digits = int(at[65:91].sum()), int(at[97:123].sum()), int(at[48:58].sum())
    marks = int(at[33:48].sum() + at[58:65].sum() + at[91:97].sum() + at[123:127].sum())
    ratios = [
        symbols / n,
        marks / n,
        upper / max(1, upper + lower),
        digits / max(1, chars),
        repeat / n,
        dup / max(1, len(lines)),
        chars / n,
        len(set(words)) / n ** 0.9,
        int(at[33]) / n,
        min(1.0, len(words) / 50),
    ]
    return [len(words), chars, symbols, dup, repeat], ratios


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, ``keep``, the five counts, ``base_failed`` and the array ``ratios`` of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        made = [statistics_of(t) for t in batch.column("text").to_pylist()]
        names = [c.split()[0] for c in COUNTS.split(", ")]
        counts = {n: pa.array([m[0][i] for m in made], pa.int64()) for i, n in enumerate(names)}
        return counts | {"ratios": pa.array([m[1] for m in made], pa.list_(pa.float64()))}

    counted = by_batch(
        with_text(docs, "doc_id", *keep), f"{COUNTS}, ratios array<double>", run, keep=("doc_id", *keep)
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


@dataclass
class Forest:
    """Trees as arrays in heap order: the split of a node, or the path length of a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    typical: float
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 in steps of ``1 / STEPS``; higher is stranger."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[row, np.maximum(f, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return np.rint(np.exp2(-total / (len(self.feature) * self.typical)) * STEPS) / STEPS

    def of(self, batch: pa.RecordBatch) -> pa.Array:
        """The scores of a batch with a column ``ratios``."""
        return pa.array(self.score(batch.column("ratios").flatten().to_numpy().reshape(-1, FEATURES)))


def _unfinished(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def bearing(rows: DataFrame) -> np.ndarray:
    """How well each ratio alone tells the labels apart: 0 (as chance) to 1, ``LEAST_WEIGHT`` at least.

    The good rows below a value are counted along stretches of the values.
    """
    good = (F.col("quality") == 1).cast("long")
    values = rows.select(F.posexplode("ratios").alias("ratio", "value"), good.alias("good"))
    values = values.groupBy("ratio", "value").agg(F.sum("good").alias("fine"), F.sum(1 - F.col("good")).alias("bad"))
    full = values.groupBy("ratio").agg(F.count(F.lit(1)).alias("_m"), quantiles("value").alias("_q"))
    cuts = full.select("ratio", cuts_of("_q", F.ceil(F.col("_m") / VALUES).cast("int")).alias("_cuts"))
    # one row for each ratio
    cells = values.join(F.broadcast(cuts), "ratio").withColumn("_cell", part_of(F.col("value"), F.col("_cuts")))
    before = Window.partitionBy("ratio").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy("ratio", "_cell").agg(F.sum("fine").alias("_fine"))
    starts = totals.select("ratio", "_cell", F.coalesce(F.sum("_fine").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("ratio", "_cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.drop("_cuts").withColumn("_up_to", F.sum("fine").over(inside)).join(starts, ["ratio", "_cell"])
    below = 2 * (F.col("_start") + F.col("_up_to")) - F.col("fine")
    sums = placed.groupBy("ratio").agg(
        F.sum((F.col("bad") * below).cast("decimal(38,0)")).cast("double").alias("below"),
        F.sum("fine").alias("fine"),
        F.sum("bad").alias("bad"),
    )
    share = {r.ratio: r.below / (r.fine * r.bad) for r in sums.collect()}
    return np.maximum(np.abs(np.array([share[i] for i in range(FEATURES)]) - 1), LEAST_WEIGHT)


def _dealt(mark: np.ndarray, trees: int, copies: int) -> np.ndarray:
    """For each row the ``copies`` trees that its 64 bits and theirs put first, as rows x copies."""
    if copies >= trees:
        return np.tile(np.arange(trees), (len(mark), 1))
    z = mark.view(np.uint64)[:, None] ^ (np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.argpartition(z ^ (z >> np.uint64(31)), copies - 1, axis=1)[:, :copies]


def grow(
    rows: DataFrame, n: int, weight: np.ndarray, seed: int = 7, trees: int = TREES, subsample: int = SUBSAMPLE
) -> Forest:
    """An isolation forest of all ``n`` rows that splits by a ratio as often as its weight says.

    ``rows`` has the columns ``mark`` (bits that tell rows apart) and ``ratios``. A level is one pass:
    a task finds the ranges of the ratios in the open nodes, and Spark puts those of all tasks together.
    """
    copies = int(min(trees, max(1, -(-trees * subsample // n))))
    depth = max(1, int(np.ceil(np.log2(max(2, min(subsample, n))))))
    nodes = 2 ** (depth + 1) - 1
    forest = Forest(
        np.full((trees, nodes), -1, np.int64),
        np.zeros((trees, nodes)),
        np.zeros((trees, nodes)),
        max(_unfinished(n * copies / trees), 1e-9),
    )
    lows, highs = ([f"{side}{i}" for i in range(FEATURES)] for side in ("low", "high"))
    schema = "place int, n bigint, " + ", ".join(f"{c} double" for c in lows + highs)

    def ranges(level: int):
        first, wide = 2**level - 1, 2**level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros(trees * wide, np.int64)
            low, high = (np.full((trees * wide, FEATURES), v) for v in (np.inf, -np.inf))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("ratios").flatten().to_numpy().reshape(-1, FEATURES)
                tree = _dealt(batch.column("mark").to_numpy(), trees, copies)
                row = np.repeat(np.arange(len(x)), copies)
                tree, node = tree.ravel(), np.zeros(len(row), np.int64)
                for _ in range(level):
                    f = forest.feature[tree, node]
                    row, tree, node, f = (v[f >= 0] for v in (row, tree, node, f))
                    node = 2 * node + 1 + (x[row, f] > forest.cut[tree, node])
                place = tree * wide + node - first
                order = np.argsort(place, kind="stable")
                place, row = place[order], row[order]
                at, start, many = np.unique(place, return_index=True, return_counts=True)
                if not len(at):
                    continue
                count[at] += many
                low[at] = np.minimum(low[at], np.minimum.reduceat(x[row], start))
                high[at] = np.maximum(high[at], np.maximum.reduceat(x[row], start))
            some = np.flatnonzero(count)
            columns = [pa.array(some, pa.int32()), pa.array(count[some])]
            columns += [pa.array(side[some, i]) for side in (low, high) for i in range(FEATURES)]
            yield pa.RecordBatch.from_arrays(columns, ["place", "n", *lows, *highs])

        return run

    for level in range(depth + 1):
        found = rows.select("mark", "ratios").mapInArrow(ranges(level), schema)
        sides = [F.min(c).alias(c) for c in lows] + [F.max(c).alias(c) for c in highs]
        table = found.groupBy("place").agg(F.sum("n").alias("n"), *sides).toArrow().sort_by("place")
        place, many = table.column("place").to_numpy(), table.column("n").to_numpy()
        low, high = (np.stack([table.column(c).to_numpy() for c in side], 1) for side in (lows, highs))
        random = np.random.default_rng([seed, level])
        for p, size, a, b in zip(place, many, low, high):
            tree, node = int(p) >> level, int(p) % 2**level + 2**level - 1
            open_to = np.flatnonzero(b > a)
            if level == depth or not len(open_to):
                forest.length[tree, node] = level + _unfinished(int(size))
                continue
            f = random.choice(open_to, p=weight[open_to] / weight[open_to].sum())
            forest.feature[tree, node] = f
            # rows up to the cut go left: the highest must stay right of it
            forest.cut[tree, node] = min(random.uniform(a[f], b[f]), np.nextafter(b[f], a[f]))
    return forest


def best_cut(scores: np.ndarray, good: np.ndarray, count: np.ndarray | None = None) -> float:
    """The cut of the best balanced accuracy, halfway to the next score; where none is bad, the highest score.

    A score may stand for ``count`` rows.
    """
    count = np.ones(len(scores)) if count is None else count
    at, place = np.unique(scores, return_inverse=True)
    fine, bad = (np.cumsum(np.bincount(place, count * kind, len(at))) for kind in (good, ~good))
    if not bad[-1]:
        return float(at[-1])
    best = int(np.argmax(fine / fine[-1] - bad / bad[-1]))
    return float(at[best : best + 2].mean())


def fit(docs: DataFrame, labels: DataFrame, *, sent: int = LABELS_SENT) -> Forest | None:
    """A forest and its threshold from all labelled rows that pass the base rule.

    A document that is labelled twice is bad if one label says so.
    """
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    chosen, small = broadcast_if_small(chosen, sent)
    if small:
        measured = statistics(texts.join(chosen, "doc_id"), "quality", "text_hash")
    else:
        measured = statistics(texts, "text_hash").join(chosen, "doc_id")
    measured = measured.filter(~F.col("base_failed")).select("doc_id", "text_hash", "quality", "ratios")
    good = F.col("quality") == 1
    # read once for each step of the fit
    measured = checkpointed(measured.withColumn("_h", F.xxhash64("doc_id", "text_hash")))
    n = {r.good: r.n for r in measured.groupBy(good.alias("good")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(n.values()) < 8 or len(n) < 2 or n[True] < 2:
        return None
    # every other row of each label, counted in parts that a task can hold
    parts = F.when(good, -(-n[True] // PART_ROWS)).otherwise(-(-n[False] // PART_ROWS))
    inside = Window.partitionBy(good, "_part").orderBy("_h", "doc_id", "text_hash")
    numbered = measured.withColumn("_part", F.pmod("_h", parts)).withColumn("_seq", F.row_number().over(inside) - 1)
    rows = checkpointed(
        numbered.select(
            F.xxhash64("_h", "_seq").alias("mark"), ((F.col("_seq") + F.col("_part")) % 2 == 0).alias("grows"), "quality", "ratios"
        )
    )
    grown, others = rows.filter("grows"), rows.filter("not grows")
    forest = grow(grown, grown.count(), bearing(grown))
    scored = by_batch(
        others.select("quality", "ratios"), "anomaly double", lambda b: {"anomaly": forest.of(b)}, keep=("quality",)
    )
    scores = scored.groupBy("anomaly", (F.col("quality") == 1).alias("good")).agg(F.count(F.lit(1)).alias("n"))
    at = scores.toArrow()
    forest.threshold = best_cut(*(at.column(c).to_numpy() for c in ("anomaly", "good", "n")))
    return forest


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """Statistics of every row, its anomaly score, and whether it is kept."""
    measured = statistics(docs)
    kept = tuple(c for c in measured.columns if c != "ratios")
    threshold = forest.threshold if forest else np.inf

    def run(batch: pa.RecordBatch) -> dict:
        return {"anomaly": forest.of(batch) if forest else pa.array(np.zeros(batch.num_rows))}

    scored = by_batch(measured, "anomaly double", run, keep=kept)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(threshold)))
