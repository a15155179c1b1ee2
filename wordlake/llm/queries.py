"""Registered queries of this package: thin, each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordlake.llm.bpe import bpe_decode, bpe_encode
from wordlake.llm.embedding_dedup import embedding_components
from wordlake.llm.jaccard_join import jaccard_components
from wordlake.llm.lm_scoring import lm_scores
from wordlake.llm.mixing import mix_sources
from wordlake.llm.period_runs import period_runs
from wordlake.llm.quality import quality_rules
from wordlake.llm.revisits import resolve_revisits
from wordlake.llm.spelling import document_words, spelling_variants
from wordlake.llm.suffix_dedup import suffix_dedup
from wordlake.llm.token_counts import token_counts
from wordlake.llm.toxicity import toxicity
from wordlake.llm.winnowing import decontaminate
from wordlake.sources.tables import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Target weights of the mix; nodes without one weigh 1.
WEIGHTS = {"web": 2.0, "print": 1.0, "web/en": 4.0, "web/de": 2.0, "print/en": 3.0, "web/en/src0": 1.0, "web/en/src2": 2.0}
BUDGET_SHARE = 0.8
MAX_EPOCHS = 4


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the lattice model of those whose crc32 mod 10 is not 0."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    scores = lm_scores(table(spark, sf_dir, "documents"), PIECES, train=~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), *scores.columns[1:])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression bands over all documents."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links (cosine 0.95) and components."""
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the group of documents that links of 5-word shingles (Jaccard 0.8) reach."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's part in a mix of 0.8 times the corpus, at most 4 epochs a leaf."""
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, BUDGET_SHARE, MAX_EPOCHS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the network fitted on labels of those whose crc32 mod 5 is not 0."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    scores = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the best segmentation of every document."""
    return token_counts(table(spark, sf_dir, "documents"), PIECES)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 100-byte strings repeat from earlier ones."""
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and of the decoded bytes."""
    t = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), RANKS), RANKS)
    return t.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                    F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def revisit_records(pages: DataFrame) -> DataFrame:
    """Archive records of all pages: each page's full response, and a later revisit of its URL in another spelling.

    The revisit of a page has its own entity tag, none (every 7th, a date instead) or a wrong one (every 5th); it
    repeats the digest unless the page is a 3rd.
    """
    digest = F.md5("html")
    same = F.col("page_id") % 5 != 0
    date = F.col("page_id").cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (F.col("page_id") * 10).alias("ts"), digest.alias("etag"),
        date.alias("last_modified"), digest.alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), date, F.lit("cache-control"), F.lit("max-age=60")).alias("headers"))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(F.col("url"), F.lit("#seen")).alias("url"),
        (F.col("page_id") * 10 + 5).alias("ts"),
        F.when(F.col("page_id") % 7 != 0, F.when(same, F.concat(F.lit("W/"), digest)).otherwise(F.lit("other"))).alias("etag"), date.alias("last_modified"),
        F.when(F.col("page_id") % 3 != 0, digest).alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(date, F.lit("r")), F.lit("etag"), digest).alias("headers"))
    return response.unionByName(revisit)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages resolved; headers as text, one a line, by name."""
    out = resolve_revisits(revisit_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.withColumn("headers", lines)


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a stretch of 10 words (or a whole shorter item) of the benchmark."""
    hit = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hit.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def misspelt(words: DataFrame) -> DataFrame:
    """``words`` (doc_id, word) where every 199th pair of document and word lost one code point."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    at = F.pmod(F.col("h"), F.char_length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
    return words.withColumn("h", h).select("doc_id", F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("word")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some misspelt, with their usual spelling."""
    return spelling_variants(misspelt(document_words(table(spark, sf_dir, "documents"))))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``; every tenth document repeats a stretch of its words to its end (null ids: none)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    w = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    w = w.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    w = w.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    w = w.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.floor((F.col("n") - F.col("a")) / F.col("p")).cast("int") + 1
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    text = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a")))
    return w.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, the one of greatest exponent, and digests of the runs and of the collapsed texts."""
    found = period_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.when(F.size("runs") > 0, F.array_sort("runs", lambda a, b: F.when(
        a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1)
        .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))[0])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _op5_sql() -> str:
    weights = ", ".join(f"('{k}', {float(v)})" for k, v in sorted(WEIGHTS.items()))

    def fill(src: str, parent: str, name: str, out: str) -> str:
        p = f"partition by {parent} " if parent else ""
        return (f"{out}_l as (select *, (parent_budget - coalesce(sum(cap) over ({p}order by cap / weight, {name} rows between unbounded preceding and 1 preceding), 0)) / "
                f"sum(weight) over ({p}order by cap / weight, {name} rows between current row and unbounded following) as lev from {src}), "
                f"{out} as (select *, least(cap::double, max(lev) over ({p}) * weight) as budget from {out}_l)")

    domain = "case when regexp_matches(source, '[02468]$') then 'web' when regexp_matches(source, '[13579]$') then 'print' else 'other' end"
    return f"""
with w(path, weight) as (values {weights}),
d as (select doc_id, {domain} as domain, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens)::bigint as available, sum(n_tokens)::bigint * {MAX_EPOCHS} as cap from d group by all),
total as (select least(sum(available) * {BUDGET_SHARE}::double, (sum(available) * {MAX_EPOCHS})::double) as parent_budget from leaf),
n1 as (select domain, sum(cap)::bigint as cap, coalesce(any_value(weight), 1.0)::double as weight, any_value(parent_budget) as parent_budget
  from leaf left join w on path = domain, total group by domain),
{fill("n1", "", "domain", "b1")},
n2 as (select l.domain, l.lang, sum(l.cap)::bigint as cap, coalesce(any_value(w.weight), 1.0)::double as weight, any_value(b1.budget) as parent_budget
  from leaf l join b1 using (domain) left join w on path = l.domain || '/' || l.lang group by l.domain, l.lang),
{fill("n2", "domain", "lang", "b2")},
n3 as (select l.domain, l.lang, l.source, l.available, l.cap, coalesce(w.weight, 1.0)::double as weight, b2.budget as parent_budget
  from leaf l join b2 using (domain, lang) left join w on path = l.domain || '/' || l.lang || '/' || l.source),
{fill("n3", "domain, lang", "source", "b3")},
q as (select *, floor(budget + 1e-6)::bigint as quota, case when available > 0 then floor(budget + 1e-6)::bigint // available else 0 end as full_epochs from b3),
o as (select d.*, q.full_epochs, q.quota - q.full_epochs * q.available as rest,
  md5('17|' || q.full_epochs || '|' || doc_id) as h from d join q using (domain, lang, source)),
c as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by h, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as before from o),
t as (select *, greatest(0, least(n_tokens, rest - before))::bigint as prefix_tokens from c)
select doc_id, domain, lang, source, n_tokens, full_epochs::bigint as full_epochs, prefix_tokens,
  (full_epochs * n_tokens + prefix_tokens)::bigint as total_tokens from t"""


OP10_SQL = r"""
with p as (select page_id, md5(html) as digest, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') as plain from pages),
u as (select *, list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'), lambda x: x <> '' and not list_contains(
  ['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'], string_split(x, '=')[1]))) as args from p),
k as (select *, regexp_replace(lower(regexp_extract(plain, '^([^/?]*)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(plain, '^[^/?]*([^?]*)', 1), '/+$', '')
  || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end as canonical_url from u),
r as (select page_id * 2 as record_id, true as full_one, canonical_url, page_id * 10 as ts, digest as etag, page_id::varchar as lm, digest, page_id from k
 union all select page_id * 2 + 1, false, canonical_url, page_id * 10 + 5,
  case when page_id % 7 <> 0 then case when page_id % 5 <> 0 then digest else 'other' end end, page_id::varchar, case when page_id % 3 <> 0 then digest end, page_id from k),
a as (select *, last_value(case when full_one then {'id': record_id, 'etag': etag, 'lm': lm, 'digest': digest} end ignore nulls)
  over (partition by canonical_url order by ts, record_id rows between unbounded preceding and 1 preceding) as f from r),
o as (select *, case when f is null then 'no_response'
  when (etag is not null and etag <> f.etag) or (etag is null and lm <> f.lm) or coalesce(digest <> f.digest, false) then 'changed' else 'resolved' end as outcome
  from a where not full_one)
select record_id, canonical_url, ts, outcome, case when outcome = 'resolved' then f.id end as response_id,
  case when outcome = 'resolved' then f.digest end as response_digest,
  case when outcome = 'resolved' then 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || page_id || 'r' || chr(10)
    || 'etag: ' || (select any_value(k.digest) from k where k.page_id = o.page_id) end as headers from o"""

#: Stretches are 10 words joined by one space; an item of fewer words is one stretch.
OP11_SQL = r"""
with d as (select doc_id, row_number() over () as k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, span, array_to_string(w[i:i + span - 1], ' ') as stretch
  from (select item_id, w, least(len(w), 10) as span, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
spans as (select distinct span from bw),
dw as (select k, i, span, array_to_string(w[i:i + span - 1], ' ') as stretch
  from (select k, w, span, unnest(range(1, len(w) - span + 2)) as i from d, spans where len(w) >= span)),
m as (select k, i, dw.span, item_id from dw join bw on dw.stretch = bw.stretch and dw.span = bw.span),
hit as (select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + span)) as p from m) group by k),
ids as (select k, list_sort(list(distinct item_id::varchar)) as items from m group by k)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (k) left join ids using (k)"""

LLM_QUERIES = {f.__name__: f for f in (op1_lattice_lm, op2_quality_rules, op3_projection_passes, op4_ngram_jaccard,
                                         op5_source_mixing, op6_toxicity, op7_token_counts, op8_suffix_dedup, op9_bpe_round_trip, op10_warc_revisits,
                                         op11_winnowing, op12_spelling_variants, op13_period_runs)}
LLM_SQL = {"op5_source_mixing": _op5_sql(), "op10_warc_revisits": OP10_SQL, "op11_winnowing": OP11_SQL}
