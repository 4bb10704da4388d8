"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts earlier.

Sorting every suffix of a corpus would move many times its size. Only suffixes at anchors
are sorted: every ``LENGTH``-byte string has one anchor, the place of the least hash among
its ``TOKEN``-byte tokens, so equal strings have equal anchors at equal offsets, and about
one byte in thirty starts a suffix.

1. Each anchor is a suffix with its leading token and a hash of its segment, the bytes of
   all strings that have it as anchor. ``repartitionByRange`` draws splitters from a sample
   and cuts the suffixes into ranges; each bucket is sorted by multikey sort. Within a
   token, a segment that was there before is a copy from end to end. Segments seen first
   beside others of their token may still share a part with them.
2. The texts of those segments are fetched, put in ranges of (token, suffix), and the
   strings of each token are sorted by their bytes, eight at a time, each pass only over
   what all earlier passes left tied; equal neighbours are copies of the first.

A token may run over several buckets, so of its first and last token a bucket hands over
the first of each kind that may lie beyond its boundary too, and an aggregation compares
those. Copies of one kind within a bucket are decided there, so a hot group adds one row
for each bucket it runs through. Rows that must outlive their job are written to the
shared folder.

Defined results: a missing or empty text is zero bytes and stays; documents without an id
come last in order; rows that share a ``doc_id`` are told apart by a hash of their texts,
and rows repeated with the same text are one document, reported once a row with the same
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craquelure.llm.common import arrow_bounds, blobs, by_batch, shared_folder, with_text

LENGTH = 100
TOKEN = 32
STRINGS = LENGTH - TOKEN + 1
# bytes that are hashed in one numpy pass
STRETCH = 1 << 19

# place of a suffix in its text: anchor, bytes before it in its segment, further strings
_POS, _LEFT = 14, 7
_NO_ID = (1 << 63) - 1
_COPY, _CANDIDATE, _OPEN = 0, 1, 2
_SUFFIX = "token bigint, seg bigint, doc bigint, sig bigint, place bigint"

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES2 = np.random.default_rng(21).integers(0, 1 << 64, 256, dtype=np.uint64)


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, sig, text``: the id in the order of documents, and a hash of the text."""
    return with_text(docs, "doc_id").select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.xxhash64("text").alias("sig"),
        "text",
    )


def _stretches(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts, about ``STRETCH`` bytes together, with the number of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        held.append(raw)
        size += len(raw)
        if size >= STRETCH:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base, np.uint64))


def anchored(parts: list[bytes]) -> dict[str, np.ndarray]:
    """Anchors of the texts: number of the text, token hash, segment hash, anchor, bytes before it, strings."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    nothing = {n: np.zeros(0, np.int64) for n in ("text", "anchor", "left", "strings")}
    if len(raw) < LENGTH:
        return nothing | {n: np.zeros(0, np.uint64) for n in ("token", "seg")}
    hashed, span, base = _BYTES[raw], 1, _BASE
    while span < TOKEN:
        n = len(hashed) - span
        hashed = hashed[:n] * np.uint64(base) + hashed[span:]
        base, span = base * base % (1 << 64), span * 2
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    # least hash of each string, the leftmost among equals: the place is in the low bits
    bits = np.uint64(len(raw).bit_length())
    least = (hashed >> bits << bits) | np.arange(len(hashed), dtype=np.uint64)
    span = 1
    while span * 2 <= STRINGS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < STRINGS:
        least = np.minimum(least[: span - STRINGS], least[STRINGS - span :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    string = np.arange(len(at))
    text = np.repeat(np.arange(len(parts)), sizes)[: len(at)]
    valid = string + LENGTH <= ends[text]
    begins = valid.copy()
    begins[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(begins)
    strings = np.add.reduceat(valid, first) if len(first) else np.zeros(0, np.int64)
    # hash of any range from sums that end at its two sides
    forward, back = _powers(_BASE, len(raw)), _powers(pow(_BASE, -1, 1 << 64), len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES2[raw] * back)])
    seg = (sums[first + strings - 1 + LENGTH] - sums[first]) * forward[first]
    seg = (seg ^ (seg >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + strings.astype(np.uint64)
    anchor = at[first]
    return {
        "text": text[first],
        "token": hashed[anchor],
        "seg": seg,
        "anchor": anchor - starts[text[first]],
        "left": anchor - first,
        "strings": strings.astype(np.int64),
    }


def suffixes(texts: DataFrame) -> DataFrame:
    """One row for each anchor of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sigs = batch.column("doc").to_numpy(), batch.column("sig").to_numpy()
            for first, parts in _stretches(batch.column("text").to_pylist()):
                a = anchored(parts)
                row = a["text"] + first
                place = (a["anchor"] << _POS) | (a["left"] << _LEFT) | (a["strings"] - 1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": pa.array(a["token"].view(np.int64)),
                        "seg": pa.array(a["seg"].view(np.int64)),
                        "doc": pa.array(docs[row]),
                        "sig": pa.array(sigs[row]),
                        "place": pa.array(place),
                    }
                )

    arrow_bounds(texts.sparkSession)
    return texts.select("doc", "sig", "text").mapInArrow(run, _SUFFIX)


def multikey_order(rows: int, keys) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows and the number of each one's group of equals, in that order.

    ``keys`` gives one function a level; it returns the keys of the rows it is handed. A
    level looks only at groups that tie on all levels before it, and sorts only those in
    which its key differs. Equal rows stay in their order.
    """
    order = np.arange(rows)
    fresh = np.zeros(rows, bool)
    fresh[:1] = True
    for key in keys:
        group = np.cumsum(fresh) - 1
        tied = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1) if rows else group
        if not len(tied):
            break
        value, own = key(order[tied]), group[tied]
        differs = np.zeros(len(tied), bool)
        differs[1:] = (value[1:] != value[:-1]) & (own[1:] == own[:-1])
        mixed = np.isin(own, own[differs]) if differs.any() else differs
        if not mixed.any():
            continue
        some = tied[mixed]
        inner = np.lexsort((value[mixed], own[mixed]))
        order[some] = order[some][inner]
        value, own = value[mixed][inner], own[mixed][inner]
        fresh[some[1:]] |= (value[1:] != value[:-1]) & (own[1:] == own[:-1])
    return order, np.cumsum(fresh) - 1


def _buckets(df: DataFrame) -> int:
    """A bucket is held whole by its task, so there are more of them than partitions of other shuffles, and none are merged."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a bucket; the splitters bound their number."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _outer(token: np.ndarray) -> np.ndarray:
    """Rows of the first and the last token of a bucket, whose tokens are sorted."""
    return (token == token[0]) | (token == token[-1])


def compare_suffixes(found: DataFrame) -> DataFrame:
    """``kind`` and the suffix: copies, candidates for a partial match, and what boundaries leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _gathered(batches)
        if bucket is None:
            return
        names = ("token", "seg", "doc", "sig", "place")
        columns = [bucket.column(n).to_numpy() for n in names]
        del bucket
        order, _ = multikey_order(len(columns[0]), [lambda i, c=c: c[i] for c in columns])
        for i, c in enumerate(columns):
            columns[i] = c[order]
        del c, order
        token, seg, doc, sig, place = columns
        new_token = np.r_[True, token[1:] != token[:-1]]
        first = new_token | np.r_[True, seg[1:] != seg[:-1]]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        copy = (doc != doc[lead]) | (sig != sig[lead]) | (place != place[lead])
        segments = np.bincount(np.cumsum(new_token) - 1, weights=first)[np.cumsum(new_token) - 1]
        outer = _outer(token)
        kind = np.full(len(token), -1, np.int32)
        kind[copy] = _COPY
        kind[first & ~outer & (segments > 1)] = _CANDIDATE
        kind[first & outer] = _OPEN
        some = np.flatnonzero(kind >= 0)
        yield pa.RecordBatch.from_pydict(
            {n: pa.array(c[some]) for n, c in zip(("kind", *names), (kind, token, seg, doc, sig, place))}
        )

    arrow_bounds(found.sparkSession)
    ranged = found.repartitionByRange(_buckets(found), "token", "seg", "doc", "sig", "place")
    return ranged.mapInArrow(run, f"kind int, {_SUFFIX}")


def packed(texts: DataFrame) -> DataFrame:
    """``doc_id, doc, sig`` and the compressed bytes of the text, which cross shuffles at a third of their size."""

    def run(batch: pa.RecordBatch) -> dict:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        return {"bytes": blobs([pack(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()])}

    return by_batch(texts, "bytes binary", run, keep=("doc_id", "doc", "sig"))


def _unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _anchor(place: Column) -> Column:
    return F.shiftright(place, _POS)


def segments(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidates with the bytes of their segments before the anchor and from it on.

    ``many`` is the number of the token's candidates, by which a bucket knows a token that it holds whole.
    """
    many = candidates.groupBy("token").agg(F.count(F.lit(1)).alias("many"))
    wanted = (
        candidates.join(many, "token")
        .groupBy("doc", "sig")
        .agg(F.collect_list(F.struct("token", "place", "many")).alias("wanted"))
    )
    rows = packed(texts).drop("doc_id").join(wanted, ["doc", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {"token": [], "doc": [], "sig": [], "place": [], "many": [], "before": [], "suffix": []}
            for doc, sig, data, wanted in zip(*(batch.column(n).to_pylist() for n in ("doc", "sig", "bytes", "wanted"))):
                raw = _unpack(data)
                for w in wanted:
                    place = w["place"]
                    anchor, left = place >> _POS, place >> _LEFT & 127
                    made["token"].append(w["token"])
                    made["doc"].append(doc)
                    made["sig"].append(sig)
                    made["place"].append(place)
                    made["many"].append(w["many"])
                    made["before"].append(raw[anchor - left : anchor])
                    made["suffix"].append(raw[anchor : anchor - left + (place & 127) + LENGTH])
            kinds = (*[pa.int64()] * 5, pa.binary(), pa.binary())
            yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for (n, v), k in zip(made.items(), kinds)})

    arrow_bounds(rows.sparkSession)
    schema = "token bigint, doc bigint, sig bigint, place bigint, many bigint, before binary, suffix binary"
    return rows.mapInArrow(run, schema)


def _common(suffixes: list[bytes], other: bytes) -> np.ndarray:
    """Bytes that each suffix has in common with another one from the start."""
    wide = max(len(other), 1)
    rows = np.frombuffer(b"".join(x[:wide].ljust(wide, b"\0") for x in suffixes), np.uint8).reshape(-1, wide)
    differs = rows != np.frombuffer(other.ljust(wide, b"\0"), np.uint8)
    first = np.where(differs.any(1), differs.argmax(1), wide)
    return np.minimum(first, np.minimum([len(x) for x in suffixes], len(other)))


def compare_strings(found: DataFrame) -> DataFrame:
    """``string, doc, sig, start, strings``: runs of copied strings; with ``string`` set, one that is still open.

    Ranges follow (token, suffix). Equal strings have equal suffixes as far as the string
    reaches, so they lie side by side, and a boundary parts them only if both its
    neighbours share that much: only such strings stay open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _gathered(batches)
        if bucket is None:
            return
        columns = [bucket.column(n).to_numpy() for n in ("token", "doc", "sig", "place")]
        order = np.lexsort(columns[::-1])
        # a repeated row is the same place again
        own = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)]
        order = order[own]
        token, doc, sig, place = (c[order] for c in columns)
        many = bucket.column("many").to_numpy()[order]
        before, suffix = (
            bucket.column(n).combine_chunks().take(pa.array(order)).to_pylist() for n in ("before", "suffix")
        )
        pieces = [a + b for a, b in zip(before, suffix)]
        raw = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
        eight = np.zeros(len(raw) - 8, np.uint64)
        for k in range(8):
            eight |= raw[k : k - 8].astype(np.uint64) << np.uint64(56 - 8 * k)
        counts = (place & 127) + 1
        left = place >> _LEFT & 127
        base = np.cumsum([0] + [len(p) for p in pieces])[:-1]
        row = np.repeat(np.arange(len(token)), counts)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = base[row] + inner
        rest = np.uint64((1 << 64) - (1 << 8 * (8 - LENGTH % 8))) if LENGTH % 8 else np.uint64(0)
        levels = [lambda i: token[row[i]]]
        levels += [lambda i, k=k: eight[at[i] + 8 * k] for k in range(LENGTH // 8)]
        levels.append(lambda i: eight[at[i] + LENGTH // 8 * 8] & rest)
        order, group = multikey_order(len(row), levels)
        copy = np.zeros(len(row), bool)
        copy[order[1:]] = group[1:] == group[:-1]
        start = (place >> _POS) - left
        begins = copy & np.r_[True, ~copy[:-1] | (row[1:] != row[:-1])]
        first = np.flatnonzero(begins)
        runs = np.add.reduceat(copy, first) if len(first) else np.zeros(0, np.int64)
        # how far each suffix agrees with the bucket's outermost one, where its token may run on
        shared = np.zeros(len(token), np.int64)
        for name, pick in ((token[0], min), (token[-1], max)):
            same = np.flatnonzero(token == name)
            if len(same) == many[same[0]]:
                continue  # all of the token is here
            here = [suffix[i] for i in same]
            shared[same] = np.maximum(shared[same], _common(here, pick(here)))
        reach = LENGTH - left[row] + inner
        undecided = np.flatnonzero(~copy & (reach <= shared[row]))
        both = np.concatenate([first, undecided])
        strings = [None] * len(first) + [raw[a : a + LENGTH].tobytes() for a in at[undecided]]
        yield pa.RecordBatch.from_pydict(
            {
                "string": pa.array(strings, pa.binary()),
                "doc": pa.array(doc[row[both]]),
                "sig": pa.array(sig[row[both]]),
                "start": pa.array(start[row[both]] + inner[both]),
                "strings": pa.array(np.concatenate([runs, np.ones(len(undecided))]).astype(np.int64)),
            }
        )

    arrow_bounds(found.sparkSession)
    ranged = found.repartitionByRange(_buckets(found), "token", "suffix", "doc", "sig", "place")
    return ranged.mapInArrow(run, "string binary, doc bigint, sig bigint, start bigint, strings bigint")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def copied_runs(texts: DataFrame) -> DataFrame:
    """``doc, sig, start, strings``: runs of strings that also start earlier."""
    compared = _kept(compare_suffixes(suffixes(texts)), "suffixes")
    left_open = compared.filter(F.col("kind") == _OPEN)
    here = F.struct("doc", "sig", "place")
    segment = left_open.groupBy("token", "seg").agg(F.min(here).alias("first"))
    several = segment.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")
    candidates = compared.filter(F.col("kind") == _CANDIDATE).select("token", "doc", "sig", "place").unionByName(
        segment.join(several, "token").select("token", "first.*")
    )
    later = left_open.join(segment, ["token", "seg"]).filter(here != F.col("first")).select("doc", "sig", "place")
    copies = compared.filter(F.col("kind") == _COPY).select("doc", "sig", "place").unionByName(later)
    whole = copies.select(
        "doc",
        "sig",
        (_anchor(F.col("place")) - F.shiftright("place", _LEFT).bitwiseAND(F.lit(127))).alias("start"),
        (F.col("place").bitwiseAND(F.lit(127)) + 1).alias("strings"),
    )
    parts = _kept(compare_strings(segments(candidates, texts)), "strings")
    undecided = parts.filter("string is not null")
    there = F.struct("doc", "sig", "start")
    first = undecided.groupBy("string").agg(F.min(there).alias("first"))
    crossing = undecided.join(first, "string").filter(there != F.col("first"))
    columns = ("doc", "sig", "start", "strings")
    return (
        whole.select(*columns)
        .unionByName(parts.filter("string is null").select(*columns))
        .unionByName(crossing.select(*columns))
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, kept`` and the removed ``spans`` (start, end) of every row."""
    texts = documents(docs)
    runs = copied_runs(texts).groupBy("doc", "sig").agg(F.collect_list(F.struct("start", "strings")).alias("runs"))
    rows = packed(texts).join(runs, ["doc", "sig"], "left")

    def run(batch: pa.RecordBatch) -> dict:
        sizes, kept, spans = [], [], []
        runs = batch.column("runs")
        flat = runs.values
        start, strings = flat.field("start").to_numpy(), flat.field("strings").to_numpy()
        bounds = runs.offsets.to_numpy()
        for i, data in enumerate(batch.column("bytes").to_pylist()):
            raw = _unpack(data)
            sizes.append(len(raw))
            a, b = bounds[i], bounds[i + 1]
            change = np.zeros(len(raw) + 1, np.int32)
            np.add.at(change, start[a:b], 1)
            np.add.at(change, start[a:b] + strings[a:b] - 1 + LENGTH, -1)
            gone = np.cumsum(change) > 0
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
            kept.append(np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes() if b > a else raw)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return {"n_bytes": pa.array(sizes, pa.int64()), "kept": blobs(kept), "spans": pa.array(spans, pa.list_(span))}

    schema = "n_bytes bigint, kept binary, spans array<struct<start: bigint, end: bigint>>"
    return by_batch(rows, schema, run, keep=("doc_id",))
