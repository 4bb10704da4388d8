"""Toxicity by two class-conditional Kneser-Ney models over bytes.

Counts of byte n-grams (order ``ORDER``, lower-cased, everything but letters a blank) of all
labelled training rows are summed per class. Each class interpolates its own counts with
one backoff distribution that both share: Kneser-Ney continuation counts of the pooled
n-grams, down to single bytes. What a text is scored with is the ratio of the two
likelihoods per byte. It is summed over the whole text and over every window of ``SPAN``
bytes from a word's start, each divided by its length, and a logistic curve through the
mean and the highest windows, fitted on a bounded sample, gives the probability.

An n-gram that training never saw is predicted by what its context holds back for the shared
distribution. That distribution cancels in the ratio, so a context's ratio of the two shares
is all there is to keep; a context that no class saw tells nothing. Where one class has far more
texts, its contexts hold less back, and an n-gram new to both speaks for the other class. So the
unseen part of a text's mean has a weight of its own, and windows, of which only the highest are
looked at, add up counted n-grams alone.

All counting and smoothing are DataFrame aggregates and joins, and every counted n-gram and
context has its ratio. Up to ``RATIOS_SENT`` go to the tasks as an exact table. Beyond that, texts
are dealt into chunks of about ``CHUNK`` characters, the different n-grams of a chunk are
joined with all ratios, and the chunk is scored with what it finds; the scores are the same.
(Texts are dealt by id and text, so rows that agree in both share a chunk.)

Defined results: a missing or empty text gets the score of a text without evidence; a
missing ``doc_id`` is never labelled and never held out; repeated rows are scored alike,
once each; a document labelled twice is toxic if one label says so; without labels of both
kinds every score is 0. Other columns are ignored; lang, source, labels and ids are no inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from craquelure.llm.common import arrow_bounds, broadcast_if_small, by_batch, checkpointed, with_text

ORDER = 6
# lengths of the n-grams that the shared distribution backs off to
BACKOFF = (5, 3, 1)
DISCOUNT = 0.75
# ratios up to this many (12 to 16 bytes each) are sent to the tasks, more are joined by a shuffle
RATIOS_SENT = 1 << 22
# characters of the texts that meet in one group of that join, about
CHUNK = 1 << 22
SPAN = 12
# characters that are counted or scored in one numpy pass
STRETCH = 1 << 19
HIGHEST = 3
# weights of one, of the mean's counted and unseen part and of the highest windows that the curve's fit starts from
PRIOR = (-5.0, 2.0, 0.0, 6.0, 3.0, 1.0)
# labelled rows that fit the logistic curve, at most
CALIBRATION = 20_000
# labels up to this many rows (12 bytes each) are sent to the tasks, more are joined by a shuffle
LABELS_SENT = 4_000_000
FOLDS, HELD_OUT, CALIBRATED = 5, 0, 4

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# neither an n-gram nor a window reaches the next text
_GAP = b" " * max(ORDER, SPAN)
_MIX = np.uint64(0x9E3779B97F4A7C15)
# above the bytes of an n-gram; set in the key of a context
_IS_CONTEXT = 1 << (8 * ORDER)


def fold() -> Column:
    """crc32 of the id's text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts with gaps between, n-gram keys by last byte, and where each text starts."""
    parts = [normal(t) for t in texts]
    raw = np.frombuffer(_GAP + _GAP.join(parts) + _GAP, np.uint8)
    starts = np.cumsum([len(_GAP)] + [len(p) + len(_GAP) for p in parts])
    key = np.zeros(len(raw), np.uint64)
    for back in range(ORDER):
        key[ORDER - 1 :] |= raw[ORDER - 1 - back : len(raw) - back].astype(np.uint64) << np.uint64(8 * back)
    return raw, key, starts


def _predicted(raw: np.ndarray) -> np.ndarray:
    """Where a byte is predicted: letters, and the blank that ends a word."""
    used = raw != 32
    used[1:] |= used[:-1]
    return used


def _context_keys(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(8)) | np.uint64(_IS_CONTEXT)


def _stretches(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about ``STRETCH`` characters; one list, if empty, where there are none."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held or not texts:
        yield held


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, fold`` of the labelled rows that are not held out."""
    marks = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("fold", fold())
        .filter(F.col("fold") != HELD_OUT)
    )
    return with_text(docs, "doc_id").join(broadcast_if_small(marks, LABELS_SENT)[0], "doc_id")


def count(rows: DataFrame) -> DataFrame:
    """``gram`` and how often it stands in texts of either class: ``toxic, plain`` outside the fold
    that calibrates, ``late_toxic, late_plain`` in it."""
    names = ("toxic", "plain", "late_toxic", "late_plain")

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        kind = (1 - batch.column("toxic").to_numpy()) + 2 * batch.column("late").to_numpy()
        grams, n = [], []
        for k in range(4):
            for some in _stretches([t for t, own in zip(texts, kind) if own == k]):
                raw, key, _ = _keys(some)
                g, c = np.unique(key[_predicted(raw)], return_counts=True)
                grams.append(g.astype(np.int64))
                n.append([c * (k == j) for j in range(4)])
        made = {name: pa.array(np.concatenate([x[j] for x in n]).astype(np.int64)) for j, name in enumerate(names)}
        return {"gram": pa.array(np.concatenate(grams))} | made

    late = (F.col("fold") == CALIBRATED).cast("int").alias("late")
    counted = by_batch(
        rows.select("text", "toxic", late), "gram bigint, " + ", ".join(f"{n} bigint" for n in names), run
    )
    return counted.groupBy("gram").agg(*(F.sum(n).alias(n) for n in names))


def _suffix(gram: str, length: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << (8 * length)) - 1))


def _context(gram: str) -> Column:
    return F.shiftright(gram, 8)


def shared_backoff(grams: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """``suffix, backoff``: Kneser-Ney probability of the last byte given the ones before, both classes pooled.

    An n-gram of a lower level counts how many of the level above end in it.
    """
    levels = {}
    above = grams.select("gram")
    for length in BACKOFF:
        above = above.groupBy(_suffix("gram", length).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[length] = above
    lowest = levels[BACKOFF[-1]]
    total = F.broadcast(lowest.agg(F.sum("n").alias("total")))
    smoothed = lowest.join(total).select("gram", (F.col("n") * 0.99 / F.col("total") + 0.01 / 256).alias("p"))
    for length, shorter in zip(BACKOFF[-2::-1], BACKOFF[::-1]):
        here = levels[length].withColumn("context", _context("gram")).withColumn("tail", _suffix("gram", shorter))
        contexts = here.groupBy("context").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        lower = smoothed.select(F.col("gram").alias("tail"), "p")
        own = F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("p")
        smoothed = here.join(contexts, "context").join(lower, "tail").select("gram", (own / F.col("all")).alias("p"))
    return smoothed.select(F.col("gram").alias("suffix"), F.col("p").alias("backoff"))


def ratios(grams: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """``gram, ratio, early``: log of the last byte's probability in toxic over that in ordinary texts.

    A row with the bit ``_IS_CONTEXT`` stands for every n-gram after its context that was never
    counted. ``early`` leaves the counts of the calibrating fold out of both classes; it is missing
    where nothing else counted the n-gram.
    """
    counts = {
        "toxic": F.col("toxic") + F.col("late_toxic"),
        "plain": F.col("plain") + F.col("late_plain"),
        "early_toxic": F.col("toxic"),
        "early_plain": F.col("plain"),
    }
    here = grams.select(
        "gram",
        _context("gram").alias("context"),
        _suffix("gram", ORDER - 1).alias("suffix"),
        *(c.alias(f"n_{k}") for k, c in counts.items()),
    )
    sums = [F.sum(f"n_{k}").alias(f"all_{k}") for k in counts]
    kinds = [F.count_if(F.col(f"n_{k}") > 0).alias(f"kinds_{k}") for k in counts]
    contexts = here.groupBy("context").agg(*sums, *kinds)

    def held_back(kind: str) -> Column:
        # a context that the class never saw leaves the shared distribution alone
        return F.coalesce(F.try_divide(discount * F.col(f"kinds_{kind}"), F.col(f"all_{kind}")), F.lit(1.0))

    def likelihood(kind: str) -> Column:
        own = F.try_divide(F.greatest(F.col(f"n_{kind}") - discount, F.lit(0.0)), F.col(f"all_{kind}"))
        return F.coalesce(own, F.lit(0.0)) + held_back(kind) * F.col("backoff")

    def both(of: Callable[[str], Column]) -> list[Column]:
        pairs = (("ratio", "toxic", "plain"), ("early", "early_toxic", "early_plain"))
        return [F.ln(of(one) / of(other)).alias(name) for name, one, other in pairs]

    counted = here.join(contexts, "context").join(shared_backoff(grams, discount), "suffix")
    unseen = contexts.select(F.col("context").bitwiseOR(F.lit(_IS_CONTEXT)).alias("gram"), *both(held_back))
    ratio, early = both(likelihood)
    # an n-gram of the calibrating fold alone is new to the counts without it
    early = F.when(F.col("n_early_toxic") + F.col("n_early_plain") > 0, early).alias("early")
    return counted.select("gram", ratio, early).unionByName(unseen)


@dataclass
class Ratios:
    """Ratios by n-gram or context: mixed keys in order, and where each run of leading bits starts."""

    keys: np.ndarray
    ratio: np.ndarray
    bits: int
    starts: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, ratio: np.ndarray) -> Ratios:
        # an odd factor modulo 2**64 can be undone, so different n-grams have different keys
        keys = grams.astype(np.uint64)
        keys *= _MIX
        order = np.argsort(keys)
        keys, ratio = keys[order], ratio[order].astype(np.float32, copy=False)
        del order
        bits = max(1, len(keys).bit_length())
        starts = np.zeros((1 << bits) + 1, np.int32)
        slots = np.bincount((keys >> np.uint64(64 - bits)).view(np.int64), minlength=1 << bits)
        starts[1:] = np.cumsum(slots, out=slots)
        return cls(keys, ratio, bits, starts)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The ratio of each n-gram; its context's for one never counted, 0 without either."""
        return sum(self.parts(grams))

    def parts(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratios of counted n-grams and those of the contexts of others, 0 elsewhere."""
        counted, missing = self._look_up(grams)
        unseen = np.zeros_like(counted)
        unseen[missing] = self._look_up(_context_keys(grams[missing]))[0]
        return counted, unseen

    def _look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio of each key, and which keys have none."""
        keys = grams * _MIX
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int32)
        at, end = self.starts[slot], self.starts[slot + 1]
        found = np.zeros(len(keys), np.float32)
        missing = np.ones(len(keys), bool)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == keys[left]
            found[left[hit]] = self.ratio[here[hit]]
            missing[left[hit]] = False
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found, missing


@dataclass
class Model:
    """Ratios of all n-grams, or of those that the texts have, and the logistic curve."""

    ratios: Ratios
    weights: np.ndarray

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Mean ratio of each text, by counted and unseen n-grams, and its highest windows' mean ratios."""
        return np.concatenate([self._evidence(some) for some in _stretches(texts)])

    def _evidence(self, texts: list[str]) -> np.ndarray:
        raw, key, starts = _keys(texts)
        used = _predicted(raw)
        counted, unseen = np.zeros((2, len(raw)), np.float32)
        counted[used], unseen[used] = self.ratios.parts(key[used])
        letter = raw != 32
        seen = np.concatenate([[0.0], np.cumsum(counted, dtype=np.float64)])
        new = np.concatenate([[0.0], np.cumsum(unseen, dtype=np.float64)])
        letters = np.concatenate([[0], np.cumsum(letter)])
        first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        window = (seen[np.minimum(first + SPAN, len(raw))] - seen[first]) / SPAN
        edge = np.searchsorted(first, starts)
        out = np.zeros((len(texts), 2 + HIGHEST))
        for i in range(len(texts)):
            a, b = starts[i], starts[i + 1] - len(_GAP)
            out[i, :2] = np.array([seen[b] - seen[a], new[b] - new[a]]) / max(1, letters[b] - letters[a])
            found = window[edge[i] : edge[i + 1]]
            if len(found):
                top = np.partition(found, -HIGHEST)[-HIGHEST:] if len(found) > HIGHEST else found
                out[i, 2 : 2 + len(top)] = np.sort(np.maximum(top, 0))[::-1]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(_design(self.evidence(texts)) @ self.weights)


@dataclass
class Joined:
    """As ``Model``, where the ratios are too many to be sent: ``gram`` and the column ``name`` of a table."""

    table: DataFrame
    name: str
    weights: np.ndarray

    def by_chunk(self, rows: DataFrame, schema: str | StructType, fn: Callable[[pa.Table, Model], pa.Table]) -> DataFrame:
        """``fn`` turns the rows of each chunk into others, with a model that has the ratios of their n-grams."""
        size = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        chunk = "chunk"
        while chunk in rows.columns:
            chunk += "_"
        dealt_by = F.xxhash64(*(c for c in ("doc_id", "text") if c in rows.columns))
        dealt = rows.withColumn(chunk, F.pmod(dealt_by, F.lit(-(-size // CHUNK) or 1)).cast("int"))
        weights = self.weights

        def of(raw: np.ndarray, keys: np.ndarray) -> np.ndarray:
            return np.unique(keys[_predicted(raw)])

        def different(key: tuple, group: pa.Table) -> pa.Table:
            texts = [t or "" for t in group.column("text").to_pylist()]
            grams = np.unique(np.concatenate([of(*_keys(some)[:2]) for some in _stretches(texts)]))
            grams = np.concatenate([grams, np.unique(_context_keys(grams))])
            number = np.full(len(grams), key[0].as_py(), np.int32)
            return pa.table({chunk: pa.array(number), "gram": pa.array(grams.astype(np.int64))})

        def judge(group: pa.Table, known: pa.Table) -> pa.Table:
            ratios = Ratios.of(known.column("gram").to_numpy(), known.column("ratio").to_numpy())
            return fn(group.drop_columns([chunk]), Model(ratios, weights))

        grams = dealt.select(chunk, "text").groupBy(chunk).applyInArrow(different, f"`{chunk}` int, gram bigint")
        known = grams.join(self.table.select("gram", F.col(self.name).alias("ratio")).dropna(), "gram")
        known = known.select(chunk, "gram", "ratio")
        return dealt.groupBy(chunk).cogroup(known.groupBy(chunk)).applyInArrow(judge, schema)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _design(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(evidence)), evidence])


def _logistic(evidence: np.ndarray, toxic: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of the curve; few labelled rows leave them near ``PRIOR``."""
    x = _design(evidence)
    prior = np.array(PRIOR)
    weights = prior.copy()
    penalty = ridge * np.eye(len(weights))
    for _ in range(50):
        p = _sigmoid(x @ weights)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - penalty @ (weights - prior))
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _fetched(table: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table, missing numbers as NaN; what Arrow took to bring them goes back at once."""
    brought = table.toArrow()
    columns = {name: np.array(brought.column(name).to_numpy()) for name in brought.column_names}
    del brought
    pa.default_memory_pool().release_unused()
    return columns


def fit(
    docs: DataFrame, labels: DataFrame, *, calibration: int = CALIBRATION, most: int = RATIOS_SENT
) -> Model | Joined | None:
    """Models from all labelled training rows; the curve is fitted with counts that leave its own fold out.

    Up to ``most`` ratios come to the driver and are sent, more stay a table.
    """
    rows = labelled(docs, labels)
    grams = checkpointed(count(rows))
    table = ratios(grams).select("gram", *(F.col(n).cast("float").alias(n) for n in ("ratio", "early")))
    # a context has one n-gram at least, so there are no more contexts than n-grams
    if 2 * grams.count() <= most:
        held = _fetched(table)

        def model(name: str, weights: np.ndarray) -> Model:
            # a column is used once, and the driver has little room
            own = held.pop(name)
            there = ~np.isnan(own)
            return Model(Ratios.of(held["gram"][there], own[there]), weights)
    else:
        model = partial(Joined, checkpointed(table))

    marked = labels.select("doc_id").filter(fold() == CALIBRATED).distinct()
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration)
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi")

    def measure(group: pa.RecordBatch | pa.Table, model: Model) -> dict:
        x = model.evidence(group.column("text").to_pylist())
        return {"toxic": group.column("toxic"), "evidence": pa.array(x.tolist(), pa.list_(pa.float64()))}

    early = model("early", np.zeros(len(PRIOR)))
    seen = _measured(
        sample.select("doc_id", "toxic", "text"), early, "toxic int, evidence array<double>", measure
    ).limit(calibration).collect()
    del early
    toxic = np.array([r.toxic for r in seen], float)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    return model("ratio", _logistic(np.array([r.evidence for r in seen]), toxic))


def _measured(
    rows: DataFrame,
    model: Model | Joined | None,
    schema: str | StructType,
    fn: Callable[[pa.RecordBatch | pa.Table, Model | None], dict],
) -> DataFrame:
    """The columns that ``fn`` makes of rows and a model, which is sent or joined."""
    if isinstance(model, Joined):
        return model.by_chunk(rows, schema, lambda group, known: pa.table(fn(group, known)))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch, sent.value))

    arrow_bounds(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | Joined | None, *keep: str) -> DataFrame:
    """``doc_id``, ``keep`` and ``score`` (0 to 1) of every row."""
    columns = tuple(dict.fromkeys(("doc_id", *keep)))
    rows = with_text(docs, *columns)
    kept = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in columns)

    def run(group: pa.RecordBatch | pa.Table, model: Model | None) -> dict:
        texts = group.column("text").to_pylist()
        made = np.zeros(len(texts)) if model is None else model.score(texts)
        return {n: group.column(n) for n in columns} | {"score": pa.array(made)}

    return _measured(rows, model, f"{kept}, score double", run)


def keep_below(docs: DataFrame, model: Model | Joined | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, columns as they were."""
    columns = tuple(docs.columns)

    def run(group: pa.RecordBatch | pa.Table, model: Model | None) -> dict:
        if model is not None:
            below = model.score([t or "" for t in group.column("text").to_pylist()]) < threshold
            group = group.filter(pa.array(below))
        return {n: group.column(n) for n in columns}

    return _measured(docs, model, docs.schema, run)
