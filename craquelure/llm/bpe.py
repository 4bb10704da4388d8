"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to ``chunk_chars`` are one chunk. Longer ones are cut into chunks that overlap by
``overlap`` characters, so one document is pre-tokenised by many tasks. The pattern looks
at nothing before a pre-token, hence two neighbouring chunks agree from the first start
of a pre-token they have in common; there they are stitched. Every chunk then encodes its
own pre-tokens, and the ids are put together in order. Where an overlap has no common
start (one run of characters longer than the overlap), the document is encoded uncut.

Defined results: a missing or empty text has no ids and decodes to no bytes; a missing
``doc_id`` is kept; repeated rows are encoded alike, once each; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from craquelure.llm.common import arrow_bounds, blobs, by_batch, lists, row_key, with_text

CHUNK_CHARS = 1 << 16
OVERLAP = 1 << 10
# pre-tokens whose ids a Python worker remembers before it starts afresh
REMEMBERED = 100_000


@lru_cache(maxsize=4)
def vocabulary(ranks_path: str) -> list[bytes]:
    """The bytes of every id; ids without a token have none."""
    with open(ranks_path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks.get(rank, b"") for rank in range(max(ranks) + 1)]


class Coder:
    """Ids and bytes of pre-tokens under one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        ranks = {token: rank for rank, token in enumerate(vocabulary(ranks_path)) if token}
        self.pattern = regex.compile(pattern)
        # one match is the whole piece: the pre-token was found before
        self.merges = tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def learn(self, piece: str) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        ids = np.array(self.merges.encode_ordinary(piece), np.int32).tobytes()
        if len(piece) <= 64:
            self.known[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens as little-endian 32-bit numbers."""
        get = self.known.get
        return b"".join([get(p) or self.learn(p) for p in pieces])

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


@lru_cache(maxsize=4)
def coder(ranks_path: str, pattern: str) -> Coder:
    return Coder(ranks_path, pattern)


def _id_lists(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return lists(np.frombuffer(b"".join(parts), np.int32), offsets, pa.int32())


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id`` and ``token_ids`` of every row of ``docs``."""
    if not 0 < overlap < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk")

    def whole(batch: pa.RecordBatch) -> dict:
        c = coder(ranks_path, pattern)
        split = c.pattern.findall
        return {"token_ids": _id_lists([c.encode(split(t)) for t in batch.column("text").to_pylist()])}

    texts = with_text(docs, "doc_id")
    short = by_batch(
        texts.filter(F.length("text") <= chunk_chars), "token_ids array<int>", whole, keep=("doc_id",)
    )

    # long texts: equal rows are cut once
    long = (
        texts.filter(F.length("text") > chunk_chars)
        .groupBy("doc_id", "text")
        .agg(F.count(F.lit(1)).cast("int").alias("copies"))
        .withColumn("key", row_key("doc_id", "text"))
    )
    parts = _chunks(long, chunk_chars, overlap)
    marked = by_batch(
        parts,
        "head array<int>, tail array<int>",
        _marks(ranks_path, pattern, chunk_chars, overlap),
        keep=("key", "part", "start", "chunk"),
    )
    order = Window.partitionBy("key").orderBy("part")
    document = Window.partitionBy("key")
    entry = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    stitched = (
        marked.withColumn("entry", F.when(F.col("part") == 0, F.lit(0)).otherwise(entry))
        .withColumn("until", F.lead("entry").over(order))
        .withColumn("broken", F.max(F.col("entry").isNull()).over(document))
    )

    def slices(batch: pa.RecordBatch) -> dict:
        c = coder(ranks_path, pattern)
        out = []
        columns = (batch.column(n).to_pylist() for n in ("chunk", "start", "entry", "until"))
        for chunk, start, first, until in zip(*columns):
            pieces = []
            for m in c.pattern.finditer(chunk, first - start):
                if until is not None and m.start() + start >= until:
                    break
                pieces.append(m.group())
            out.append(c.encode(pieces))
        return {"ids": _id_lists(out)}

    joined = (
        by_batch(stitched.filter(~F.col("broken")), "ids array<int>", slices, keep=("key", "part"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts"))
        .select("key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("token_ids"))
    )
    owners = long.select("key", "doc_id", "copies")
    stitched_rows = owners.join(joined, "key").select(
        F.explode(F.array_repeat("doc_id", F.col("copies"))).alias("doc_id"), "token_ids"
    )
    broken = stitched.filter("broken and part = 0").select("key")
    uncut = (
        long.join(broken, "key", "left_semi")
        .select(F.explode(F.array_repeat("doc_id", F.col("copies"))).alias("doc_id"), "text")
    )
    return short.unionByName(stitched_rows).unionByName(
        by_batch(uncut, "token_ids array<int>", whole, keep=("doc_id",))
    )


def _chunks(long: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                starts = list(range(0, len(text), chunk_chars))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([key] * len(starts), pa.string()),
                        "part": pa.array(range(len(starts)), pa.int32()),
                        "start": pa.array(starts, pa.int32()),
                        "chunk": [text[s : s + chunk_chars + overlap] for s in starts],
                    }
                )

    arrow_bounds(long.sparkSession)
    cuts = long.select("key", "text").mapInArrow(cut, "key string, part int, start int, chunk string")
    return cuts.repartition("key", "part")


def _marks(ranks_path: str, pattern: str, chunk_chars: int, overlap: int):
    def mark(batch: pa.RecordBatch) -> dict:
        c = coder(ranks_path, pattern)
        heads, tails = [], []
        for chunk, start in zip(batch.column("chunk").to_pylist(), batch.column("start").to_pylist()):
            found = c.starts(chunk)
            heads.append([start + s for s in found if s < overlap])
            tails.append([start + s for s in found if s >= chunk_chars])
        kind = pa.list_(pa.int32())
        return {"head": pa.array(heads, kind), "tail": pa.array(tails, kind)}

    return mark


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Every column of ``encoded`` and ``decoded``, the concatenated bytes of ``token_ids``."""

    def run(batch: pa.RecordBatch) -> dict:
        word = vocabulary(ranks_path).__getitem__
        column = batch.column("token_ids")
        ids = column.values.to_numpy(zero_copy_only=False)
        at = column.offsets.to_numpy()
        return {"decoded": blobs([b"".join(map(word, ids[a:b].tolist())) for a, b in zip(at[:-1], at[1:])])}

    return by_batch(encoded, "decoded binary", run, keep=tuple(encoded.columns))
