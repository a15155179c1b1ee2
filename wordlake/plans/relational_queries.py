"""Registered relational, aggregation, sort and set queries (P, J, A, O, U).

Fixture roles (SURVEY 7.2): posts -> orders, pages -> customer
(o_totalprice / c_acctbal as share / fan_count), HN posts -> events
(ts, value), corpus -> documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordlake.functions import text as tx
from wordlake.operators import relational as rl
from wordlake.operators import sketches as sk
from wordlake.operators import stats as st
from wordlake.operators import vocab as vb
from wordlake.plans import sqlfrag as q
from wordlake.plans.registry import Tables, query

R6 = 6


@query("p01_select", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def p01_select(spark, d):
    """Column selection."""
    return Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("p02_drop", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def p02_drop(spark, d):
    """Drop columns."""
    return Tables(spark, d).customer.drop("c_name", "c_mktsegment")


@query("p03_rename", "SELECT page_id AS id, url AS link FROM pages")
def p03_rename(spark, d):
    """Rename."""
    return Tables(spark, d).pages.select("page_id", "url").withColumnsRenamed({"page_id": "id", "url": "link"})


@query("p04_cast", """SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
  CAST(trunc(o_totalprice) AS INTEGER) AS price_int, CAST(o_custkey AS DOUBLE) AS cust_d FROM orders""")
def p04_cast(spark, d):
    """Casts (string id, truncating int, double)."""
    o = Tables(spark, d).orders
    return o.select(o.o_orderkey.cast("string").alias("order_id"),
                    o.o_totalprice.cast("int").alias("price_int"),
                    o.o_custkey.cast("double").alias("cust_d"))


@query("p05_type_filter", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def p05_type_filter(spark, d):
    """P5: equality filter (pushed to the parquet scan)."""
    o = Tables(spark, d).orders
    return o.where(o.o_orderstatus == "F").select("o_orderkey", "o_custkey", "o_totalprice")


@query("p06_conjunction", """SELECT event_id, user_id, value FROM events
  WHERE event_type = 'click' AND value >= 10 AND user_id IS NOT NULL""")
def p06_conjunction(spark, d):
    """Conjunction filter."""
    e = Tables(spark, d).events
    return e.where((e.event_type == "click") & (e.value >= 10) & e.user_id.isNotNull()) \
        .select("event_id", "user_id", "value")


@query("p07_not_null", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def p07_not_null(spark, d):
    """Not-null filter."""
    t = Tables(spark, d).documents
    return t.where(t.text.isNotNull() & t.lang.isNotNull()).select("doc_id", "lang")


@query("p08_range", "SELECT event_id, value FROM events WHERE value >= 50 AND value < 200")
def p08_range(spark, d):
    """Range filter."""
    e = Tables(spark, d).events
    return e.where((e.value >= 50) & (e.value < 200)).select("event_id", "value")


@query("p09_ratio", """SELECT o_orderkey, c_custkey,
  round(CASE WHEN c_acctbal = 0 THEN NULL ELSE o_totalprice / c_acctbal END, 6) AS share_ratio
FROM orders JOIN customer ON o_custkey = c_custkey""")
def p09_ratio(spark, d):
    """Ratio feature share/fan_count = o_totalprice / c_acctbal (NULL on 0)."""
    t = Tables(spark, d)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", "c_custkey",
                    F.round(rl.ratio("o_totalprice", "c_acctbal"), R6).alias("share_ratio"))


@query("p10_scale_by_max", """SELECT event_id, round(value / max(value) OVER (), 6) AS value_scaled FROM events""")
def p10_scale_by_max(spark, d):
    """Divide by the global maximum (one-row aggregate, broadcast)."""
    e = Tables(spark, d).events.select("event_id", "value")
    return rl.scale_by_max(e, "value", "value_scaled").select(
        "event_id", F.round("value_scaled", R6).alias("value_scaled"))


@query("p11_threshold_label", """SELECT event_id, CAST(value >= 50 AS INTEGER) AS label_ge,
  CAST(value > 50 AS INTEGER) AS label_gt FROM events""")
def p11_threshold_label(spark, d):
    """Binary labels from a threshold (>= and > forms)."""
    e = Tables(spark, d).events
    return e.select("event_id", rl.threshold_label("value", 50).alias("label_ge"),
                    rl.threshold_label("value", 50, ">").alias("label_gt"))


@query("p15_point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def p15_point_lookup(spark, d):
    """Point lookup by key (parquet min/max pruning on doc_id)."""
    t = Tables(spark, d).documents
    return t.where(t.doc_id == 7).select("doc_id", "lang", "source", "n_chars")


@query("j01_inner", """SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d
  JOIN labels l ON d.doc_id = l.doc_id""")
def j01_inner(spark, d):
    """Inner equi-join on the same key."""
    t = Tables(spark, d)
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id")


@query("j02_suffix_join", """SELECT d.doc_id, c.turn, c.role, d.lang,
  CAST(length(d.text) AS INTEGER) AS len_x, CAST(length(c.text) AS INTEGER) AS len_y
FROM documents d JOIN conversations c ON d.doc_id = c.conv_id""")
def j02_suffix_join(spark, d):
    """Different key names; the colliding `text` becomes text_x / text_y."""
    t = Tables(spark, d)
    m = rl.merge(t.documents.select("doc_id", "text", "lang"),
                 t.conversations.select("conv_id", "turn", "role", "text"), "doc_id", "conv_id")
    return m.select("doc_id", "turn", "role", "lang",
                    F.length("text_x").alias("len_x"), F.length("text_y").alias("len_y"))


@query("j03_three_way", """SELECT c_mktsegment, o_orderstatus, count(*) AS n_lines,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment, o_orderstatus""")
def j03_three_way(spark, d):
    """Three-way inner join chain (Catalyst/AQE choose order and strategy)."""
    t = Tables(spark, d)
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")) \
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("j04_row_aligned", f"""SELECT d.doc_id, CAST(len({q.regexp_tokens('d.text')}) AS INTEGER) AS n_tokens,
  l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def j04_row_aligned(spark, d):
    """Features aligned with labels by an explicit key (no row index)."""
    t = Tables(spark, d)
    feats = t.documents.select("doc_id", F.size(tx.regexp_tokens("text")).alias("n_tokens"))
    return feats.join(t.labels.select("doc_id", "quality"), "doc_id")


_URL_NUM = r"[0-9]+"


@query("j05_lookup_default", f"""WITH a AS (SELECT page_id, regexp_extract_all(url, '{_URL_NUM}') AS arr FROM pages),
t AS (SELECT page_id, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS pos, unnest(arr) AS token FROM a),
dflt AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT t.page_id, t.pos, t.token, CAST(e.vec_id IS NOT NULL AS INTEGER) AS hit,
  round(list_sum(list_transform(coalesce(e.embedding, dflt.v), lambda x: CAST(x AS DOUBLE))), 6) AS vec_sum
FROM t LEFT JOIN embeddings e ON t.token = CAST(e.vec_id AS VARCHAR) CROSS JOIN dflt""")
def j05_lookup_default(spark, d):
    """Token -> vector with a default vector for misses (the vector of
    key '0', like the '.' fallback). Tokens are the numbers in page URLs."""
    t = Tables(spark, d)
    toks = vb.token_table(t.pages.select("page_id", F.regexp_extract_all("url", F.lit(_URL_NUM), F.lit(0))
                                         .alias("toks")), "toks", "page_id")
    vecs = t.embeddings.select(F.col("vec_id").cast("string").alias("word"), "embedding")
    dflt = vecs.where(F.col("word") == "0").select("embedding").scalar()  # one vector, a literal of the plan
    looked = rl.lookup_with_default(toks, vecs, "token", "word", "embedding", dflt, "vec")
    return looked.select("page_id", "pos", "token", "hit",
                         F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), R6)
                         .alias("vec_sum"))


@query("j07_coverage", f"""WITH toks AS (SELECT unnest({q.letters_only_words('text')}) AS token FROM benchmark),
v AS (SELECT DISTINCT unnest({q.letters_only_words('text')}) AS w FROM documents)
SELECT count(*) AS total, count(v.w) AS matched, CAST(count(v.w) AS DOUBLE) / count(*) AS coverage
FROM toks LEFT JOIN v ON toks.token = v.w""")
def j07_coverage(spark, d):
    """Share of benchmark tokens present in the documents vocabulary."""
    t = Tables(spark, d)
    toks = vb.token_table(t.benchmark.select("item_id", tx.letters_only_words("text").alias("w")), "w", "item_id")
    vocab = vb.token_table(t.documents.select("doc_id", tx.letters_only_words("text").alias("w")), "w", "doc_id")
    return rl.coverage(toks, vocab, "token", "token")


@query("j08_anti", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j08_anti(spark, d):
    """Complement by key (left anti-join)."""
    t = Tables(spark, d)
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti")


@query("a01_group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a01_group_count(spark, d):
    """A1: group count."""
    return Tables(spark, d).events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a02_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 2")
def a02_having(spark, d):
    """A2: keys (pages) with at least two rows (posts)."""
    return rl.having_count(Tables(spark, d).orders, "o_custkey", 2)


@query("a04_describe", """SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, min(value) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max
FROM events GROUP BY event_type""")
def a04_describe(spark, d):
    """A4: describe() per event type with exact linear quantiles."""
    out = st.describe(Tables(spark, d).events, "value", by=["event_type"])
    return out.select("event_type", "count", *[F.round(c, R6).alias(c) for c in ("mean", "std")],
                      "min", *[F.round(c, R6).alias(c) for c in ("q25", "q50", "q75")], "max")


@query("a05_describe_text", """WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders
  WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, arg_min(v, (-n, v)) AS top, max(n) AS freq FROM c""")
def a05_describe_text(spark, d):
    """A5: count / unique / top / freq of a text column."""
    return rl.describe_text(Tables(spark, d).orders, "o_orderpriority")


@query("a06_distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def a06_distinct(spark, d):
    """Distinct values."""
    return Tables(spark, d).orders.select("o_orderpriority", "o_orderstatus").distinct()


@query("a06_sketched", """SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_custkey) AS exact_n, true AS close FROM orders
GROUP BY ALL UNION ALL SELECT 'all', 'all', count(DISTINCT o_custkey), true FROM orders""")
def a06_sketched(spark, d):
    """Distinct customers by mergeable sketches, per status and
    priority and merged over all, within five standard errors (and 2) of the exact counts."""
    o = Tables(spark, d).orders
    keys = ["o_orderpriority", "o_orderstatus"]
    parts = sk.distinct_sketches(o, keys, "o_custkey")
    total = sk.merged(parts.withColumns({k: F.lit("all") for k in keys}), keys)
    exact = o.groupBy(*keys).agg(F.countDistinct("o_custkey").alias("exact_n")).unionByName(
        o.agg(F.countDistinct("o_custkey").alias("exact_n")).select(*(F.lit("all").alias(k) for k in keys), "exact_n"))
    both = sk.estimates(parts.unionByName(total)).join(exact, keys)
    return both.select(*keys, "exact_n", (F.abs(F.col("n") - F.col("exact_n")) <= F.col("exact_n") * 5 * sk.standard_error() + 2).alias("close"))


@query("a07_scalars", """SELECT max(o_totalprice) AS max_price, min(o_totalprice) AS min_price,
  round(sum(o_totalprice), 2) AS sum_price, round(avg(o_totalprice), 6) AS mean_price,
  (SELECT arg_max(doc_id, (n_chars, -doc_id)) FROM documents) AS longest_doc,
  (SELECT max(n_chars) FROM documents) AS longest_len FROM orders""")
def a07_scalars(spark, d):
    """Scalar max/min/sum/mean and the longest sequence (first on ties)."""
    t = Tables(spark, d)
    a = t.orders.agg(F.max("o_totalprice").alias("max_price"), F.min("o_totalprice").alias("min_price"),
                     F.round(F.sum("o_totalprice"), 2).alias("sum_price"),
                     F.round(F.avg("o_totalprice"), R6).alias("mean_price"))
    b = t.documents.agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest_doc"),
                        F.max("n_chars").alias("longest_len"))
    return a.crossJoin(b)


_HIST_SQL = """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * 10) AS INTEGER) + 1, 10) AS bin
      FROM events, r WHERE value >= lo AND value <= hi),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(s.bin AS INTEGER) AS bin, round(lo + (s.bin - 1) * (hi - lo) / 10, 6) AS lo,
  round(lo + s.bin * (hi - lo) / 10, 6) AS hi, coalesce(c.n, 0) AS count
FROM range(1, 11) s(bin) CROSS JOIN r LEFT JOIN c ON c.bin = s.bin"""


@query("a08_histogram", _HIST_SQL)
def a08_histogram(spark, d):
    """10 evenly spaced bins over [min, max], last bin closed."""
    h = st.histogram(Tables(spark, d).events, "value", 10)
    return h.select("bin", F.round("lo", R6).alias("lo"), F.round("hi", R6).alias("hi"), "count")


@query("a08_histogram_edges", """WITH e AS (SELECT CAST([0.0, 5.0, 10.0, 25.0, 50.0, 100.0] AS DOUBLE[]) AS edges),
b AS (SELECT CASE WHEN value = 100.0 THEN 5 ELSE len(list_filter(edges, lambda x: x <= value)) END AS bin
      FROM events, e WHERE value >= 0.0 AND value <= 100.0),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(s.bin AS INTEGER) AS bin, edges[s.bin] AS lo, edges[s.bin + 1] AS hi, coalesce(c.n, 0) AS count
FROM range(1, 6) s(bin) CROSS JOIN e LEFT JOIN c ON c.bin = s.bin""")
def a08_histogram_edges(spark, d):
    """A8 with explicit edges (values outside dropped, last bin closed)."""
    return st.histogram_edges(Tables(spark, d).events, "value", [0, 5, 10, 25, 50, 100])


@query("a09_ecdf", """SELECT event_id, value,
  round(CAST((rank() OVER (ORDER BY value)) - 1 AS DOUBLE) / count(*) OVER (), 6) AS ecdf FROM events""")
def a09_ecdf(spark, d):
    """Empirical CDF (fraction strictly below) of every event value."""
    e = Tables(spark, d).events.select("event_id", "value")
    return st.ecdf(e, "value").select("event_id", "value", F.round("ecdf", R6).alias("ecdf"))


@query("a10_class_balance", """SELECT CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
  CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg,
  round(CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 6) AS neg_per_pos,
  round(CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS frac_pos,
  round(CAST(greatest(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END), sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)) AS DOUBLE) / count(*), 6) AS majority_acc
FROM labels""")
def a10_class_balance(spark, d):
    """A10: class counts, neg/pos weight, positive share, majority accuracy."""
    b = st.class_balance(Tables(spark, d).labels, "quality")
    return b.select("pos", "neg", *[F.round(c, R6).alias(c) for c in ("neg_per_pos", "frac_pos", "majority_acc")])


@query("a11_corpus_stats", f"""WITH t AS (SELECT doc_id, {q.letters_only_words('text')} AS w FROM documents)
SELECT count(*) AS n_sequences, CAST(sum(len(w)) AS BIGINT) AS n_tokens, CAST(max(len(w)) AS INTEGER) AS longest,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM t)) AS n_symbols FROM t""")
def a11_corpus_stats(spark, d):
    """Sequences, tokens, longest sequence, distinct symbols."""
    t = Tables(spark, d).documents.select("doc_id", tx.letters_only_words("text").alias("w"))
    a = t.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum(F.size("w")).cast("long").alias("n_tokens"),
              F.max(F.size("w")).alias("longest"))
    n = vb.token_table(t, "w", "doc_id").select("token").distinct().agg(F.count(F.lit(1)).alias("n_symbols"))
    return a.crossJoin(n)


@query("a13_group_concat", """SELECT conv_id, count(*) AS n_turns,
  md5(string_agg(text, ' ' ORDER BY turn)) AS doc_md5 FROM conversations GROUP BY conv_id""")
def a13_group_concat(spark, d):
    """Concatenate a key's texts (in turn order) into one document."""
    c = Tables(spark, d).conversations
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"),
                                 F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"))
    return g.select("conv_id", "n_turns", F.md5(F.array_join(F.col("s.text"), " ")).alias("doc_md5"))


@query("a15_expon_fit", """SELECT event_type, min(value) AS loc, round(avg(value) - min(value), 6) AS scale
FROM events GROUP BY event_type""")
def a15_expon_fit(spark, d):
    """Exponential MLE per event type."""
    f = st.expon_fit(Tables(spark, d).events, "value", by=["event_type"])
    return f.select("event_type", "loc", F.round("scale", R6).alias("scale"))


@query("o02_top_n", """SELECT o_orderkey, round(o_totalprice / c_acctbal, 6) AS share_ratio
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal <> 0
ORDER BY o_totalprice / c_acctbal DESC, o_orderkey LIMIT 100""")
def o02_top_n(spark, d):
    """O1 + O2: the 100 best share ratios (ties by key)."""
    t = Tables(spark, d)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")) \
        .select("o_orderkey", rl.ratio("o_totalprice", "c_acctbal").alias("r")).where(F.col("r").isNotNull())
    top = rl.top_n(j, 100, [F.desc("r"), F.asc("o_orderkey")])
    return top.select("o_orderkey", F.round("r", R6).alias("share_ratio"))


@query("o02_top_n_per_group", """SELECT * FROM (SELECT event_type, event_id, value,
  row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def o02_top_n_per_group(spark, d):
    """Top-5 events per type (WindowGroupLimit before the shuffle)."""
    e = Tables(spark, d).events.select("event_type", "event_id", "value")
    return rl.top_n_per_group(e, ["event_type"], [F.desc("value"), F.asc("event_id")], 5)


@query("u01_union_all", """SELECT 'doc' AS src, doc_id AS id, CAST(length(text) AS INTEGER) AS n FROM documents
UNION ALL SELECT 'bench' AS src, item_id AS id, CAST(length(text) AS INTEGER) AS n FROM benchmark""")
def u01_union_all(spark, d):
    """Union all."""
    t = Tables(spark, d)
    a = t.documents.select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.length("text").alias("n"))
    b = t.benchmark.select(F.lit("bench").alias("src"), F.col("item_id").alias("id"), F.length("text").alias("n"))
    return a.unionByName(b)


@query("u02_labelled_union", """SELECT item_id AS id, md5(text) AS h, 1 AS label FROM benchmark
UNION ALL SELECT doc_id AS id, md5(text) AS h, 0 AS label FROM documents""")
def u02_labelled_union(spark, d):
    """Quotes (benchmark, 1) and books (documents, 0) with labels."""
    t = Tables(spark, d)
    a = t.benchmark.select(F.col("item_id").alias("id"), F.md5("text").alias("h"))
    b = t.documents.select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    return rl.labelled_union(a, b, 1, 0)


_PAIRS_SQL = """WITH p AS (SELECT a.conv_id, a.turn, md5(a.text) AS q1, md5(b.text) AS q2
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@query("u03_symmetric_pairs", _PAIRS_SQL + """
SELECT conv_id, turn, q1, q2 FROM p UNION ALL SELECT conv_id, turn, q2 AS q1, q1 AS q2 FROM p""")
def u03_symmetric_pairs(spark, d):
    """Question pairs (turn t, t+1) plus their swapped copies."""
    c = Tables(spark, d).conversations
    a = c.select("conv_id", "turn", F.md5("text").alias("q1"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5("text").alias("q2"))
    return rl.symmetric_pairs(a.join(b, ["conv_id", "turn"]), "q1", "q2")


@query("u05_intersection", f"""SELECT unnest({q.letters_only_words('text')}) AS symbol FROM benchmark
INTERSECT SELECT unnest({q.letters_only_words('text')}) AS symbol FROM documents""")
def u05_intersection(spark, d):
    """Vocabulary intersection."""
    t = Tables(spark, d)
    a = t.benchmark.select(F.explode(tx.letters_only_words("text")).alias("symbol"))
    b = t.documents.select(F.explode(tx.letters_only_words("text")).alias("symbol"))
    return a.intersect(b)
