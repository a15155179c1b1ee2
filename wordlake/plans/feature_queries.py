"""Registered feature, math and statistics queries
(N1-N7, P12-P14, O4, O6, W6, A12, A14, A16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.functions import math as mt
from wordlake.functions import text as tx
from wordlake.operators import relational as rl
from wordlake.operators import stats as st
from wordlake.operators import vocab as vb
from wordlake.plans import sqlfrag as q
from wordlake.plans.registry import Tables, query

R6 = 6


@query("n01_calendar", """SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day FROM events""")
def n01_calendar(spark, d):
    """Day of week (Monday = 0), hour, month, day."""
    e = Tables(spark, d).events
    cal = mt.calendar_features("ts")
    return e.select("event_id", *[c.alias(n) for n, c in cal.items()])


@query("n02_scaled_calendar", """SELECT event_id,
  round(CAST(isodow(ts) - 1 AS DOUBLE) / max(isodow(ts) - 1) OVER (), 6) AS dayofweek_s,
  round(CAST(hour(ts) AS DOUBLE) / max(hour(ts)) OVER (), 6) AS hour_s,
  round(CAST(month(ts) AS DOUBLE) / max(month(ts)) OVER (), 6) AS month_s FROM events""")
def n02_scaled_calendar(spark, d):
    """Calendar features each divided by its maximum (one-row aggregate)."""
    e = Tables(spark, d).events
    cal = mt.calendar_features("ts")
    f = e.select("event_id", cal["dayofweek"].alias("dayofweek"), cal["hour"].alias("hour"), cal["month"].alias("month"))
    mx = f.agg(*[F.max(c).alias("__m_" + c) for c in ("dayofweek", "hour", "month")])
    j = f.crossJoin(F.broadcast(mx))
    return j.select("event_id", *[F.round(F.try_divide(F.col(c).cast("double"), F.col("__m_" + c)), R6).alias(c + "_s")
                                  for c in ("dayofweek", "hour", "month")])


@query("n03_log_tower", """SELECT event_id, round(ln(greatest(ln(greatest(value, 1.0)), 1.0)), 6) AS tower2,
  round(ln(greatest(value, 1.0)), 6) AS tower1 FROM events""")
def n03_log_tower(spark, d):
    """K-fold log tower, k = 1 and 2."""
    e = Tables(spark, d).events
    return e.select("event_id", F.round(mt.log_tower("value", 2), R6).alias("tower2"),
                    F.round(mt.log_tower("value", 1), R6).alias("tower1"))


@query("n04_exp_curve", """SELECT event_id, round(exp(-0.05 * value), 6) AS f,
  round(-0.05 * exp(-0.05 * value), 6) AS d1, round(0.0025 * exp(-0.05 * value), 6) AS d2 FROM events""")
def n04_exp_curve(spark, d):
    """A e^(-bx) and its first and second derivatives (a = 1, b = 0.05)."""
    e = Tables(spark, d).events
    return e.select("event_id", F.round(mt.exp_decay("value", 1.0, 0.05), R6).alias("f"),
                    F.round(mt.exp_decay_d1("value", 1.0, 0.05), R6).alias("d1"),
                    F.round(mt.exp_decay_d2("value", 1.0, 0.05), R6).alias("d2"))


@query("n05_sigmoid", """SELECT event_id, round(1 / (1 + exp(-((value - 50) / 10))), 6) AS s,
  round((1 / (1 + exp(-((value - 50) / 10)))) * (1 - 1 / (1 + exp(-((value - 50) / 10)))), 6) AS ds FROM events""")
def n05_sigmoid(spark, d):
    """Sigmoid and its derivative form."""
    e = Tables(spark, d).events.select("event_id", mt.sigmoid((F.col("value") - 50) / 10).alias("s"))
    return e.select("event_id", F.round("s", R6).alias("s"), F.round(mt.sigmoid("s", derivative=True), R6).alias("ds"))


@query("n06_temperature_softmax", """WITH a AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]),
    lambda x: exp(ln(x * x + 0.001) / 0.5)) AS e FROM embeddings),
p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM a)
SELECT vec_id, generate_subscripts(p, 1) - 1 AS i, round(unnest(p), 6) AS p FROM p""")
def n06_temperature_softmax(spark, d):
    """Temperature softmax (T = 0.5) over the squared coordinates."""
    e = Tables(spark, d).embeddings.select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double") + 0.001).alias("a"))
    p = e.select("vec_id", mt.temperature_softmax("a", 0.5).alias("p"))
    return p.select("vec_id", F.posexplode("p").alias("i", "p")).select(
        "vec_id", F.col("i").cast("long").alias("i"), F.round("p", R6).alias("p"))


@query("n06_draw")
def n06_draw(spark, d):
    """N6 draw: one symbol (dimension) per vector by a seeded inverse CDF."""
    e = Tables(spark, d).embeddings.select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double") + 0.001).alias("a"))
    p = e.select("vec_id", mt.temperature_softmax("a", 0.5).alias("p"), mt.hash_unit("vec_id", 7).alias("u"))
    return p.select("vec_id", mt.draw_index("p", "u").alias("drawn"))


@query("n07_mask_assign", "SELECT event_id, CASE WHEN value > 1 AND value < 5 THEN 0 ELSE value END AS value FROM events")
def n07_mask_assign(spark, d):
    """Boolean mask assignment (1 < x < 5 set to 0)."""
    e = Tables(spark, d).events
    return e.select("event_id", mt.mask_range("value", 1, 5, 0.0).alias("value"))


@query("p12_zero_tail", """WITH z AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i:
    CASE WHEN i - 1 < (label + 1) * 4 THEN x ELSE 0.0 END) AS v FROM embeddings)
SELECT vec_id, CAST(len(list_filter(v, lambda x: x <> 0)) AS INTEGER) AS n_nonzero, round(list_sum(v), 6) AS s FROM z""")
def p12_zero_tail(spark, d):
    """Zero flattened positions >= length * dim (length = label + 1 tokens, dim 4)."""
    e = Tables(spark, d).embeddings
    z = e.select("vec_id", ar.zero_tail(ve_double("embedding"), F.col("label") + 1, 4).alias("v"))
    return z.select("vec_id", F.size(F.filter("v", lambda x: x != 0)).alias("n_nonzero"),
                    F.round(ar.array_sum("v"), R6).alias("s"))


def ve_double(col):
    return F.transform(F.col(col), lambda x: x.cast("double"))


@query("p13_map_lower", f"""SELECT conv_id, turn, md5(array_to_string(list_transform({q.regexp_tokens('text')},
  lambda t: lower(t)), ' ')) AS h FROM conversations""")
def p13_map_lower(spark, d):
    """Element-wise map (lower) over token arrays."""
    c = Tables(spark, d).conversations
    return c.select("conv_id", "turn", F.md5(F.array_join(tx.lower_all(tx.regexp_tokens("text")), " ")).alias("h"))


@query("p14_flatten_concat", """SELECT vec_id, CAST(len(f) AS INTEGER) AS n_features, round(list_sum(f), 6) AS s FROM (
  SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]),
    list_transform(range(10), lambda j: CASE WHEN j = label THEN 1.0 ELSE 0.0 END)) AS f FROM embeddings)""")
def p14_flatten_concat(spark, d):
    """Concatenate feature blocks (vector + one-hot label)."""
    e = Tables(spark, d).embeddings
    f = e.select("vec_id", F.concat(ve_double("embedding"),
                                    F.transform(ar.one_hot("label", 10), lambda x: x.cast("double"))).alias("f"))
    return f.select("vec_id", F.size("f").alias("n_features"), F.round(ar.array_sum("f"), R6).alias("s"))


@query("o04_topk_per_row", """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v
  FROM embeddings),
r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rk FROM x)
SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY rk) AS top3 FROM r WHERE rk <= 3 GROUP BY vec_id""")
def o04_topk_per_row(spark, d):
    """Indices of the 3 largest coordinates of each vector (argsort desc)."""
    e = Tables(spark, d).embeddings
    return e.select("vec_id", ar.int_array_string(ar.top_k_indices("embedding", 3)).alias("top3"))


@query("o06_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax FROM embeddings")
def o06_argmax(spark, d):
    """Argmax of each vector."""
    e = Tables(spark, d).embeddings
    return e.select("vec_id", ar.argmax("embedding").alias("argmax"))


_HIST30_SQL = """(WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * 30) AS INTEGER) + 1, 30) AS bin FROM events, r),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(s.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS count FROM range(1, 31) s(bin) LEFT JOIN c ON c.bin = s.bin)"""


@query("w06_elbow", f"""WITH h AS {_HIST30_SQL},
d1 AS (SELECT bin, count, count - lead(count) OVER (ORDER BY bin) AS d1 FROM h),
d2 AS (SELECT bin, count, d1, d1 - lead(d1) OVER (ORDER BY bin) AS d2 FROM d1)
SELECT bin, count, d1, d2, CAST(bin = (SELECT arg_min(bin, (-d2, bin)) FROM d2 WHERE d2 IS NOT NULL) AS INTEGER) AS is_elbow FROM d2""")
def w06_elbow(spark, d):
    """First and second differences of a 30-bin histogram and its elbow."""
    h = st.histogram(Tables(spark, d).events, "value", 30).select("bin", "count")
    return st.differences(h, "bin", "count").select("bin", "count", "d1", "d2", "is_elbow")


_BOW_SQL = f"(SELECT doc_id, {q.regexp_tokens('lower(text)', q.BOW_SQL)} AS w FROM documents)"


@query("a12_term_totals", f"""WITH t AS (SELECT unnest(w) AS term FROM {_BOW_SQL}),
c AS (SELECT term, count(*) AS total FROM t GROUP BY term)
SELECT term, total FROM c ORDER BY total DESC, term LIMIT 5000""")
def a12_term_totals(spark, d):
    """Column sums of the (5000-term) document-term matrix."""
    toks = vb.token_table(Tables(spark, d).documents.select("doc_id", tx.bow_words("text").alias("w")), "w", "doc_id")
    return toks.groupBy(F.col("token").alias("term")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "term").limit(5000)


@query("a14_char_probs", """WITH v AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark),
c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ch),
r AS (SELECT c.ch, c.n FROM c JOIN v ON c.ch = v.ch)
SELECT ch, round(n / sum(n) OVER (), 9) AS p FROM r""")
def a14_char_probs(spark, d):
    """Character unigram probabilities over documents, restricted to the
    benchmark's character vocabulary and normalized to 1."""
    t = Tables(spark, d)
    vocab = t.benchmark.select(F.explode(tx.characters("text")).alias("ch")).distinct()
    counts = t.documents.select(F.explode(tx.characters("text")).alias("ch")).groupBy("ch") \
        .agg(F.count(F.lit(1)).alias("n"))
    r = counts.join(vocab, "ch", "left_semi")
    tot = r.agg(F.sum("n").alias("__t"))
    return r.crossJoin(F.broadcast(tot)).select("ch", F.round(F.col("n") / F.col("__t"), 9).alias("p"))


@query("a16_exp_fit")
def a16_exp_fit(spark, d):
    """Least-squares fit y = a e^(-b x) to the 30-bin histogram of event
    values (log-linear start, Gauss-Newton steps as aggregates)."""
    h = st.histogram(Tables(spark, d).events, "value", 30).select((F.col("bin") - 1).alias("x"), "count")
    p = st.fit_exponential_decay(h, "x", "count")
    return spark.createDataFrame([(float(p["a"]), float(p["b"]))], "a double, b double")


@query("o05_ranked_columns", f"""WITH t AS (SELECT unnest(w) AS term FROM {_BOW_SQL}),
c AS (SELECT term, count(*) AS total FROM t GROUP BY term)
SELECT term, total, row_number() OVER (ORDER BY total DESC, term) AS rank FROM c ORDER BY total DESC, term LIMIT 100""")
def o05_ranked_columns(spark, d):
    """O5 shape: named feature scores ranked descending, first 100 (here the
    term totals; model importances use the same ranking in models)."""
    toks = Tables(spark, d).documents.select(F.explode(tx.bow_words("text")).alias("term"))
    tot = toks.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    top = rl.top_n(tot, 100, [F.desc("total"), F.asc("term")])
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), F.asc("term"))).cast("long"))


_CHARS_SQL = """(WITH v AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark),
c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ch),
r AS (SELECT c.ch, c.n FROM c JOIN v ON c.ch = v.ch)
SELECT ch, sum(n) OVER (ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n) OVER () AS cum FROM r)"""


def _hu(expr: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5({expr} || ':{seed}'), 1, 8)) AS BIGINT) / 4294967296.0"


@query("v16_corruption", f"""WITH cd AS {_CHARS_SQL},
x AS (SELECT item_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS ch FROM
  (SELECT item_id, string_split(text, '') AS s FROM benchmark)),
u AS (SELECT item_id, pos, ch, {_hu("CAST(item_id AS VARCHAR) || '|' || CAST(pos AS VARCHAR)", 1)} AS u1,
  {_hu("CAST(item_id AS VARCHAR) || '|' || CAST(pos AS VARCHAR)", 2)} AS u2 FROM x)
SELECT item_id, pos, CASE WHEN u1 < 0.15 THEN (SELECT min_by(cd.ch, cd.cum) FROM cd WHERE cd.cum > u.u2) ELSE ch END AS ch,
  CAST(u1 < 0.15 AS INTEGER) AS truth FROM u""")
def v16_corruption(spark, d):
    """Each character replaced with probability 0.15 by a character drawn
    from the A14 distribution (seeded inverse CDF); truth = 1 where replaced.
    The cumulative table is bounded by the character vocabulary and travels
    as one broadcast row of two arrays."""
    t = Tables(spark, d)
    vocab = t.benchmark.select(F.explode(tx.characters("text")).alias("ch")).distinct()
    counts = t.documents.select(F.explode(tx.characters("text")).alias("ch")).groupBy("ch") \
        .agg(F.count(F.lit(1)).alias("n")).join(vocab, "ch", "left_semi")
    cum = counts.select("ch", (F.sum("n").over(Window.orderBy("ch").rowsBetween(Window.unboundedPreceding, 0))
                               / F.sum("n").over(Window.partitionBy())).alias("cum"))
    table = cum.agg(F.sort_array(F.collect_list(F.struct("cum", "ch"))).alias("__t"))
    x = t.benchmark.select("item_id", F.posexplode(tx.characters("text")).alias("pos", "ch"))
    key = F.concat_ws("|", F.col("item_id").cast("string"), F.col("pos").cast("string"))
    u = x.select("item_id", F.col("pos").cast("long").alias("pos"), "ch",
                 mt.hash_unit(key, 1).alias("u1"), mt.hash_unit(key, 2).alias("u2")).crossJoin(F.broadcast(table))
    drawn = F.element_at(F.filter("__t", lambda e: e["cum"] > F.col("u2")), 1)["ch"]
    return u.select("item_id", "pos", F.when(F.col("u1") < 0.15, drawn).otherwise(F.col("ch")).alias("ch"),
                    (F.col("u1") < 0.15).cast("int").alias("truth"))
