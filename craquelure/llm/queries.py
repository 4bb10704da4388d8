"""The registered queries of this package, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from craquelure.llm import (
    bpe,
    decontamination,
    divergence,
    html,
    jaccard,
    licenses,
    lines,
    negatives,
    quality,
    simhash,
    suffixes,
    toxicity,
    warc,
)
from craquelure.llm.common import shared_folder, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def ranks() -> tuple[str, str]:
    """Path of the rank file and the pattern of pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents"), *ranks()), ranks()[0])
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, folder, "labels")))


@query
def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scanned = licenses.scan(docs, licenses.Index(*licenses.document_frequencies(docs)))
    base = F.sort_array(F.array_distinct("places.label"))
    every = F.sort_array(F.array_distinct(F.concat("places.label", "spans.label")))
    best = F.coalesce(F.array_max("spans.share"), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    _, records = warc.archive(table(spark, folder, "pages"), shared_folder(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op8_warc"] = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest
)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
  case when f.first < p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first < p.page_id then f.first end as refers_to
from p left join f on f.payload_digest = p.payload_digest and p.payload_bytes >= 100
"""


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.fold() == toxicity.HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = decontamination.leaks(docs, table(spark, folder, "benchmark"))
    by_row = found.groupBy(F.col("doc_id").alias("leak_id"), "text_hash").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("share").alias("share")
    )
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.col("hash") == F.col("text_hash"))
    return rows.join(by_row, same, "left").select(
        "doc_id",
        F.col("text_hash").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.array_join(F.col("items").cast("array<string>"), ",").alias("items"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )


@query
def op9_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return suffixes.dedup(table(spark, folder, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups(table(spark, folder, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op1_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup(docs, count=True).select(
        "doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


ORACLES["op1_lines"] = """
with s as (
  select doc_id, text, string_split(text, chr(10)) as ls from documents
), l as (
  select doc_id, unnest(range(0, len(ls))) as number, unnest(ls) as line from s
), f as (
  select doc_id, number, line, row_number() over (partition by line order by doc_id, number) as copy,
    translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') = '' as blank from l
), d as (
  select row_number() over (order by doc_id, number) as place, doc_id, number, line, length(line) as n
  from f where copy = 1 and not blank and length(line) >= 16
), g as (
  select place, line, n, unnest(range(1, n + 1)) as gap from d
), v as (
  select place, gap, hash(substr(line, 1, gap - 1) || substr(line, gap + 1)) as variant, n from g
), near as (
  select v.place from v join (select gap, variant, n, min(place) as least from v group by gap, variant, n) m
    on v.gap = m.gap and v.variant = m.variant and v.n = m.n and m.least < v.place
  union select greatest(v.place, d.place) from v join d on v.variant = hash(d.line) and d.n = v.n - 1
), gone as (
  select doc_id, number, 0 as near from f where copy > 1 and not blank
  union all select doc_id, number, 1 from d where place in (select place from near)
), kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.number) as text
  from l anti join gone on l.doc_id = gone.doc_id and l.number = gone.number group by l.doc_id
), n as (
  select doc_id, count(*) filter (near = 0) as n_exact, count(*) filter (near = 1) as n_near from gone group by doc_id
)
select s.doc_id, cast(coalesce(len(s.ls), 0) as bigint) as n_lines, cast(coalesce(n.n_exact, 0) as bigint) as n_exact,
  cast(coalesce(n.n_near, 0) as bigint) as n_near,
  case when s.text is not null then sha256(coalesce(kept.text, '')) end as text_sha256
from s left join kept using (doc_id) left join n using (doc_id)
"""


@query
def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html.extract(pages, html.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query
def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


ORACLES["op13_divergence"] = r"""
with d as (
  select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text
  from documents
), w as (
  select k, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from d
), c as (
  select lang, source, term, count(*) as n, count(distinct k) as docs from w group by all
), t as (
  select lang, term, sum(n) as n from c group by lang, term having sum(docs) >= 10
), l as (
  select lang, count(*) as v, sum(n) as total from t group by lang
), g as (
  select distinct lang, source from d
), gn as (
  select g.lang, g.source, coalesce(l.v, 0) as v,
    coalesce((select sum(c.n) from c semi join t using (lang, term) where c.lang = g.lang and c.source = g.source), 0) as total
  from g left join l using (lang)
), p as (
  select gn.lang, gn.source, t.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * gn.v)::hugeint as p
  from gn join t on t.lang = gn.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = t.term
), q as (
  select lang, term, 1 + (1000000000::hugeint * (t.n + 2)) // (l.total + 2 * l.v)::hugeint as q from t join l using (lang)
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
    left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p join q using (lang, term) where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked
where part = 'pair' or rank <= 10
"""


@query
def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", label)
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


ORACLES["op11_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * cast(x as double)) for x in embedding] as q
  from embeddings
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id,
  cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank,
  s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 5
"""


@query
def op12_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(table(spark, folder, "documents"))


ORACLES["op12_jaccard"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end)) as shingle
  from d
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by all
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)
), reach as (
  select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a
), least as (
  select a, min(b) as b from reach group by a
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) as component_id
from d left join n on n.doc_id = d.doc_id left join least on least.a = d.doc_id
"""
