"""Registered window, sequence-feature and co-occurrence queries
(W1-W15, V8-V21, C1-C7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.functions import text as tx
from wordlake.functions.stopwords import ENGLISH_STOP_WORDS
from wordlake.operators import blocked_pairs as bp
from wordlake.operators import cooccur as co
from wordlake.operators import sequences as sq
from wordlake.operators import vocab as vb
from wordlake.plans import sqlfrag as q
from wordlake.plans.registry import Tables, query

R6 = 6


def _conv_words(t):
    return t.conversations.select("conv_id", "turn", tx.letters_only_words("text").alias("w"))


def _doc_words(t):
    return t.documents.select("doc_id", tx.letters_only_words("text").alias("w"))


_CONV_W = f"(SELECT conv_id, turn, {q.letters_only_words('text')} AS w FROM conversations)"
_DOC_W = f"(SELECT doc_id, {q.letters_only_words('text')} AS w FROM documents)"


def _positions(src: str, keys: str) -> str:
    """One row per 1-based position i of w (n >= 1)."""
    return f"(SELECT {keys}, w, len(w) AS n, unnest(generate_series(1, len(w))) AS i FROM {src} WHERE len(w) >= 1)"


@query("w01_ngrams", f"""SELECT conv_id, turn, i - 1 AS start, array_to_string(w[i:i + 2], ' ') AS gram
FROM {_positions(_CONV_W, 'conv_id, turn')} WHERE i + 2 <= n""")
def w01_ngrams(spark, d):
    """All contiguous 3-token windows of each conversation turn."""
    r = sq.window_rows(_conv_words(Tables(spark, d)), "w", 3, ["conv_id", "turn"])
    return r.select("conv_id", "turn", F.col("start").cast("long").alias("start"),
                    F.array_join("window", " ").alias("gram"))


@query("w04_context_target", f"""SELECT conv_id, turn, i - 1 AS start, array_to_string(w[i:i + 2], ' ') AS context,
  w[i + 3] AS target FROM {_positions(_CONV_W, 'conv_id, turn')} WHERE i + 3 <= n""")
def w04_context_target(spark, d):
    """4-token windows split into (first 3 = context, last = target)."""
    r = sq.window_rows(_conv_words(Tables(spark, d)), "w", 4, ["conv_id", "turn"])
    ctx, tgt = sq.context_target("window")
    return r.select("conv_id", "turn", F.col("start").cast("long").alias("start"),
                    F.array_join(ctx, " ").alias("context"), tgt.alias("target"))


@query("w05_bigrams", f"""SELECT w[i] || '_' || w[i + 1] AS bigram, count(*) AS n
FROM {_positions(_DOC_W, 'doc_id')} WHERE i + 1 <= n GROUP BY 1""")
def w05_bigrams(spark, d):
    """Bigram strings a_b counted over all documents."""
    b = _doc_words(Tables(spark, d)).select(F.explode(sq.bigram_strings("w")).alias("bigram"))
    return b.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


_OFFS2 = "[-2, -1, 1, 2]"


@query("w09_skipgram", f"""SELECT conv_id, turn, i - 1 AS pos, o AS offset, w[i] AS word,
  CASE WHEN i + o BETWEEN 1 AND n THEN w[i + o] ELSE '--' END AS context
FROM {_positions(_CONV_W, 'conv_id, turn')}, (SELECT unnest({_OFFS2}) AS o)""")
def w09_skipgram(spark, d):
    """Skip-gram (word, context) pairs, window 2 each side, '--' padding."""
    p = sq.skipgram_pairs(_conv_words(Tables(spark, d)), "w", 2, ["conv_id", "turn"])
    return p.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "offset", "word", "context")


@query("w11_phrase_context", f"""WITH p AS (SELECT conv_id, turn, w, n, i - 1 AS t FROM {_positions(_CONV_W, 'conv_id, turn')}),
s AS (SELECT unnest([0, 1, 2, 3]) AS k)
SELECT conv_id, turn, t,
  array_to_string(list_transform(generate_series(t - 3, t - 2), lambda j: CASE WHEN j >= 0 THEN w[j + 1] ELSE '--' END), ' ') AS target,
  k - 2 AS slot,
  CASE WHEN (CASE WHEN k < 2 THEN t - 5 + k ELSE t - 3 + k END) >= 0
       THEN w[(CASE WHEN k < 2 THEN t - 5 + k ELSE t - 3 + k END) + 1] ELSE '--' END AS context
FROM p, s""")
def w11_phrase_context(spark, d):
    """2-token phrase targets with 2 left and 2 right contexts."""
    p = sq.phrase_context_pairs(_conv_words(Tables(spark, d)), "w", 2, 2, ["conv_id", "turn"])
    return p.select("conv_id", "turn", F.col("t").cast("long").alias("t"), "target", "slot", "context")


_SENTS_SQL = f"(SELECT doc_id, {q.sentences('text')} AS w FROM documents)"


@query("w12_sentence_context", f"""SELECT doc_id, i - 1 AS sent_id, o AS offset, md5(w[i]) AS sentence,
  md5(CASE WHEN i + o BETWEEN 1 AND n THEN w[i + o] ELSE '--' END) AS context
FROM {_positions(_SENTS_SQL, 'doc_id')}, (SELECT unnest([-1, 1]) AS o)""")
def w12_sentence_context(spark, d):
    """Each sentence with the previous and the next sentence ('--' pads)."""
    s = Tables(spark, d).documents.select("doc_id", F.posexplode(tx.sentences("text")).alias("sid", "s"))
    p = sq.sentence_context_pairs(s, "doc_id", "sid", "s", 1)
    return p.select("doc_id", F.col("sid").cast("long").alias("sent_id"), "offset",
                    F.md5("sentence").alias("sentence"), F.md5("context").alias("context"))


_SENT_WORDS_SQL = f"""(SELECT doc_id, list_transform({q.sentences('text')}, lambda s: {q.letters_only_words('s')}) AS s
  FROM documents)"""


@query("w13_sentence_words", f"""WITH x AS (SELECT doc_id, s, flatten(s) AS words,
    generate_subscripts(s, 1) AS k FROM {_SENT_WORDS_SQL}),
y AS (SELECT doc_id, k - 1 AS sent_id, s[k] AS sent, words,
    CAST(coalesce(list_sum(list_transform(s[1:k - 1], lambda z: len(z))), 0) AS BIGINT) AS st FROM x)
SELECT doc_id, sent_id, o AS offset, array_to_string(sent, ' ') AS sentence, CAST(len(sent) AS INTEGER) AS length,
  CASE WHEN o < 0 THEN (CASE WHEN st + o >= 0 AND st + o < len(words) THEN words[st + o + 1] ELSE '--' END)
       ELSE (CASE WHEN st + len(sent) - 1 + o < len(words) THEN words[st + len(sent) - 1 + o + 1] ELSE '--' END)
  END AS context
FROM y, (SELECT unnest([-2, -1, 1, 2]) AS o)""")
def w13_sentence_words(spark, d):
    """Each sentence with the 2 words before it and the 2 after it."""
    s = Tables(spark, d).documents.select(
        "doc_id", F.transform(tx.sentences("text"), lambda x: tx.letters_only_words(x)).alias("s"))
    p = sq.sentence_word_pairs(s, "s", 2, "doc_id")
    return p.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), "offset", "sentence",
                    "length", "context")


@query("w14_batches", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn,
  count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(floor(rn / 32) AS BIGINT) AS batch_id, CAST(rn % 32 AS INTEGER) AS batch_pos
FROM r WHERE rn < floor(n / 32) * 32""")
def w14_batches(spark, d):
    """Batches of 32 in doc_id order, incomplete last batch dropped."""
    b = sq.batches(Tables(spark, d).documents.select("doc_id"), [F.asc("doc_id")], 32)
    return b.select("doc_id", "batch_id", "batch_pos")


@query("w15_length_buckets", f"SELECT CAST(len(w) AS INTEGER) AS length, count(*) AS n_texts FROM {_CONV_W} GROUP BY 1")
def w15_length_buckets(spark, d):
    """Texts grouped by token count."""
    b = sq.length_buckets(_conv_words(Tables(spark, d)), "w")
    return b.groupBy("length").agg(F.count(F.lit(1)).alias("n_texts"))


# ------------------------------------------------- sequence features (V)

def _vocab_docs(t):
    words = _doc_words(t)
    return words, vb.frequency_vocabulary(vb.token_table(words, "w", "doc_id"))


_VOCAB_SQL = f"""(SELECT token AS symbol, row_number() OVER (ORDER BY count(*) DESC, token DESC) - 1 AS idx
  FROM (SELECT unnest(w) AS token FROM {_DOC_W}) GROUP BY token)"""
_IDS_SQL = f"""(WITH t AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM {_DOC_W}),
  k AS (SELECT t.doc_id, list(v.idx ORDER BY t.pos) AS ids FROM t JOIN {_VOCAB_SQL} v ON t.token = v.symbol
  GROUP BY t.doc_id)
  SELECT doc_id, coalesce(ids, CAST([] AS BIGINT[])) AS ids FROM documents LEFT JOIN k USING (doc_id))"""


@query("v08_batch_pad", f"""WITH v AS {_VOCAB_SQL}, e AS {_IDS_SQL},
pv AS (SELECT count(*) + 1 AS pad FROM v),
r AS (SELECT doc_id, ids, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM e),
b AS (SELECT doc_id, ids, CAST(floor(rn / 32) AS BIGINT) AS batch_id FROM r WHERE rn < floor(n / 32) * 32),
m AS (SELECT batch_id, max(len(ids)) AS mx FROM b GROUP BY batch_id)
SELECT doc_id, b.batch_id, CAST(len(ids) AS INTEGER) AS length, CAST(mx AS INTEGER) AS padded_len,
  md5(array_to_string(list_concat(ids, repeat([pad], mx - len(ids))), ',')) AS h,
  CAST(len(ids) AS DOUBLE) AS mask_sum
FROM b JOIN m ON b.batch_id = m.batch_id CROSS JOIN pv""")
def v08_batch_pad(spark, d):
    """V8: batches of 32 documents padded on the right with <PAD>, mask, lengths."""
    t = Tables(spark, d)
    words, vocab = _vocab_docs(t)
    vocab = vb.with_specials(vocab)
    pad_idx = vocab.where(F.col("symbol") == "<PAD>").select("idx")
    enc = vb.encode_rows(words, "w", vocab, "ids", unk_idx=None, keys="doc_id")
    b = sq.batches(enc.select("doc_id", "ids"), [F.asc("doc_id")], 32)
    padded = sq.pad_batches(b.crossJoin(F.broadcast(pad_idx.withColumnRenamed("idx", "__pad"))), "ids", F.col("__pad"))
    return padded.select("doc_id", "batch_id", "length", F.size("padded").alias("padded_len"),
                         F.md5(ar.int_array_string("padded")).alias("h"),
                         ar.array_sum("mask").alias("mask_sum"))


@query("v09_one_hot", """SELECT vec_id, array_to_string(list_transform(range(10), lambda j: CAST(j = label AS INTEGER)), ',') AS onehot
FROM embeddings""")
def v09_one_hot(spark, d):
    """V9: one-hot of the 10 vector labels."""
    e = Tables(spark, d).embeddings
    return e.select("vec_id", ar.int_array_string(ar.one_hot("label", 10)).alias("onehot"))


@query("v10_two_column_label", "SELECT doc_id, (1 - quality) || ',' || quality AS y FROM labels")
def v10_two_column_label(spark, d):
    """(neg, pos) label columns."""
    lb = Tables(spark, d).labels
    return lb.select("doc_id", ar.int_array_string(ar.two_column_label("quality")).alias("y"))


@query("v11_tag_index", """SELECT event_type AS symbol, count(*) AS freq,
  row_number() OVER (ORDER BY min((ts, event_id))) - 1 AS idx FROM events GROUP BY event_type""")
def v11_tag_index(spark, d):
    """Categorical index of tags by first appearance (clean form)."""
    e = Tables(spark, d).events.select("ts", "event_id", F.col("event_type").alias("token"))
    return vb.first_appearance_index(e, ["ts", "event_id"]).select("symbol", "freq", "idx")


_BOW_SQL = f"(SELECT doc_id, {q.regexp_tokens('lower(text)', q.BOW_SQL)} AS w FROM documents)"


@query("v12_bag_of_words", f"""WITH t AS (SELECT doc_id, unnest(w) AS term FROM {_BOW_SQL}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
v AS (SELECT term FROM (SELECT term, sum(tf) AS total FROM tf GROUP BY term) ORDER BY total DESC, term LIMIT 5000),
vi AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM v)
SELECT doc_id, tf.term, tf, term_idx FROM tf JOIN vi ON tf.term = vi.term""")
def v12_bag_of_words(spark, d):
    """Bag of words capped at the 5000 most frequent terms."""
    w = Tables(spark, d).documents.select("doc_id", tx.bow_words("text").alias("w"))
    return vb.bag_of_words(w, "w", "doc_id", max_features=5000).select("doc_id", "term", "tf", "term_idx")


@query("v13_bag_min_df", f"""WITH t AS (SELECT doc_id, unnest({q.remove_stops('w')}) AS term FROM {_BOW_SQL}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
v AS (SELECT term FROM tf GROUP BY term HAVING count(*) >= 20),
vi AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM v)
SELECT doc_id, tf.term, tf, term_idx FROM tf JOIN vi ON tf.term = vi.term""")
def v13_bag_min_df(spark, d):
    """Bag of words, English stop words removed, min document frequency 20."""
    w = Tables(spark, d).documents.select("doc_id", tx.remove_stop_words(tx.bow_words("text")).alias("w"))
    return vb.bag_of_words(w, "w", "doc_id", min_df=20) \
        .select("doc_id", "term", "tf", "term_idx")


@query("v14_encoder_features", f"""WITH e AS {_IDS_SQL},
f AS (SELECT doc_id, list_concat([2], list_transform(ids[1:126], lambda x: x + 4), [3]) AS s FROM e)
SELECT doc_id, md5(array_to_string(list_concat(s, list_transform(range(128 - len(s)), lambda x: 0)), ',')) AS h,
  len(s) AS mask_sum, 128 AS n_segment FROM f""")
def v14_encoder_features(spark, d):
    """[CLS] ids[:126] [SEP], zero-padded to 128, with mask and segment ids.
    Ids: 0 PAD, 1 UNK, 2 CLS, 3 SEP, vocabulary from 4."""
    t = Tables(spark, d)
    words, vocab = _vocab_docs(t)
    vocab4 = vocab.withColumn("idx", F.col("idx") + 4)
    first = words.withColumn("w", F.slice("w", 1, 126))  # only these are encoded
    enc = vb.encode_rows(first, "w", vocab4, "ids", unk_idx=1, keys="doc_id")
    f = enc.select("doc_id", sq.encoder_features("ids", 128, 2, 3, 0).alias("f"))
    return f.select("doc_id", F.md5(ar.int_array_string("f.input_ids")).alias("h"),
                    F.aggregate("f.input_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("mask_sum"),
                    F.size("f.segment_ids").alias("n_segment"))


@query("v14_pair_features", f"""WITH v AS (SELECT token AS symbol, row_number() OVER (ORDER BY count(*) DESC, token DESC) + 3 AS idx
  FROM (SELECT unnest(w) AS token FROM {_CONV_W}) GROUP BY token),
t AS (SELECT conv_id, turn, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM {_CONV_W}),
k AS (SELECT t.conv_id, t.turn, list(v.idx ORDER BY t.pos) AS ids FROM t JOIN v ON t.token = v.symbol GROUP BY t.conv_id, t.turn),
c AS (SELECT conv_id, turn, coalesce(ids, CAST([] AS BIGINT[])) AS ids FROM conversations LEFT JOIN k USING (conv_id, turn)),
p AS (SELECT a.conv_id, a.turn, a.ids AS x, b.ids AS y, CASE WHEN len(a.ids) + len(b.ids) <= 125 THEN len(a.ids)
  ELSE least(len(a.ids), greatest(63, 125 - len(b.ids))) END AS m FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
f AS (SELECT conv_id, turn, m, list_concat([2], x[1:m], [3], y[1:125 - m], [3]) AS s FROM p)
SELECT conv_id, turn, md5(array_to_string(list_concat(s, list_transform(range(128 - len(s)), lambda z: 0)), ',')) AS h,
  len(s) AS mask_sum, len(s) - m - 2 AS second_sum FROM f""")
def v14_pair_features(spark, d):
    """V14 pair form: [CLS] turn [SEP] next turn [SEP], the pair truncated to 125 ids, zero-padded to 128, with mask
    and segment ids (1 from the second turn on). Only the first 125 words of a turn can stay, so only these are encoded."""
    c = _conv_words(Tables(spark, d))
    vocab = vb.frequency_vocabulary(vb.token_table(c, "w", ["conv_id", "turn"])).withColumn("idx", F.col("idx") + 4)
    enc = vb.encode_arrays(c.withColumn("w", F.slice("w", 1, 125)), "w", vocab, "ids", unk_idx=1, keys=["conv_id", "turn"])
    a = enc.select("conv_id", "turn", F.col("ids").alias("x"))
    b = enc.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("y"))
    f = a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", sq.encoder_pair_features("x", "y", 128, 2, 3, 0).alias("f"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v).cast("long")
    return f.select("conv_id", "turn", F.md5(ar.int_array_string("f.input_ids")).alias("h"),
                    total("f.input_mask").alias("mask_sum"), total("f.segment_ids").alias("second_sum"))


@query("v15_pair_truncation", f"""WITH c AS {_CONV_W},
p AS (SELECT a.conv_id, a.turn, len(a.w) AS la, len(b.w) AS lb FROM c a JOIN c b
      ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CAST(la AS INTEGER) AS la, CAST(lb AS INTEGER) AS lb,
  CASE WHEN la + lb <= 125 THEN la ELSE least(la, greatest(63, 125 - lb)) END::INTEGER AS la_cut,
  CASE WHEN la + lb <= 125 THEN lb ELSE 125 - least(la, greatest(63, 125 - lb)) END::INTEGER AS lb_cut FROM p""")
def v15_pair_truncation(spark, d):
    """Truncate consecutive-turn pairs to 125 tokens (L=128 minus 3)."""
    c = _conv_words(Tables(spark, d))
    a = c.select("conv_id", "turn", F.size("w").alias("la"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.size("w").alias("lb"))
    p = a.join(b, ["conv_id", "turn"])
    la2, lb2 = ar.truncate_pair_lengths("la", "lb", 125)
    return p.select("conv_id", "turn", "la", "lb", la2.alias("la_cut"), lb2.alias("lb_cut"))


@query("v17_word_boundaries", f"""SELECT item_id, array_to_string(flatten(list_transform(w,
  lambda x: list_transform(generate_series(1, length(x)), lambda i: CAST(i = length(x) AS INTEGER)))), '') AS labels
FROM (SELECT item_id, {q.letters_only_words('text')} AS w FROM benchmark)""")
def v17_word_boundaries(spark, d):
    """Per character 1 on the last character of each word."""
    b = Tables(spark, d).benchmark.select("item_id", tx.letters_only_words("text").alias("w"))
    return b.select("item_id", ar.int_array_string(ar.word_end_labels("w"), "").alias("labels"))


@query("v21_shift_right", f"""WITH v AS {_VOCAB_SQL}, e AS {_IDS_SQL}
SELECT doc_id, md5(array_to_string(CASE WHEN len(ids) = 0 THEN ids ELSE list_concat([(SELECT count(*) FROM v) + 2], ids[1:len(ids) - 1]) END, ',')) AS h FROM e""")
def v21_shift_right(spark, d):
    """Decoder input = <GO> + all but the last id (same length; an empty text stays empty)."""
    t = Tables(spark, d)
    words, vocab = _vocab_docs(t)
    vocab = vb.with_specials(vocab)
    go = vocab.where(F.col("symbol") == "<GO>").select(F.col("idx").alias("__go"))
    enc = vb.encode_rows(words, "w", vocab, "ids", unk_idx=None, keys="doc_id")
    s = enc.crossJoin(F.broadcast(go)).select("doc_id", F.when(F.size("ids") == 0, F.col("ids")).otherwise(F.concat(
        F.array(F.col("__go")), F.slice("ids", 1, F.size("ids") - 1))).alias("dec"))
    return s.select("doc_id", F.md5(ar.int_array_string("dec")).alias("h"))


# ---------------------------------------------------- co-occurrence (C)

def _pairs_sql(src: str, keys: str, max_d: int, weight: str = "CAST(1 AS DOUBLE)") -> str:
    return f"""(SELECT w[i + d] AS row_word, w[i] AS col_word, {weight} AS w8
  FROM {_positions(src, keys)}, (SELECT unnest(generate_series(1, {max_d})) AS d) WHERE i + d <= n)"""


@query("c01_one_sided", f"""SELECT row_word, col_word, sum(w8) AS weight
FROM {_pairs_sql(_CONV_W, 'conv_id, turn', 2)} WHERE row_word <> col_word GROUP BY 1, 2""")
def c01_one_sided(spark, d):
    """One-sided context counts, window 2, equal words skipped."""
    return co.one_sided(_conv_words(Tables(spark, d)), "w", 2)


@query("c02_context", f"""WITH p AS (SELECT * FROM {_pairs_sql(_DOC_W, 'doc_id', 5)} WHERE row_word <> col_word)
SELECT row_word, col_word, sum(w8) AS weight FROM
  (SELECT row_word, col_word, w8 FROM p UNION ALL SELECT col_word, row_word, w8 FROM p) GROUP BY 1, 2""")
def c02_context(spark, d):
    """Two-sided context counts over documents, window 5, equal words skipped."""
    return bp.two_sided(_doc_words(Tables(spark, d)), "w", 5)


@query("c03_context_equal", f"""WITH p AS {_pairs_sql(_CONV_W, 'conv_id, turn', 2)}
SELECT row_word, col_word, sum(w8) AS weight FROM
  (SELECT row_word, col_word, w8 FROM p UNION ALL SELECT col_word, row_word, w8 FROM p) GROUP BY 1, 2""")
def c03_context_equal(spark, d):
    """Two-sided context counts with equal words kept, window 2."""
    return co.two_sided(_conv_words(Tables(spark, d)), "w", 2, skip_equal=False)


_C4_W = "CAST(greatest(least(i - 1 + 5, n - 1) - (i - 1 + d), 0) AS DOUBLE)"


@query("c04_window_pairs", f"""WITH p AS (SELECT * FROM {_pairs_sql(_DOC_W, 'doc_id', 4, _C4_W)} WHERE w8 > 0)
SELECT row_word, col_word, sum(w8) AS weight FROM
  (SELECT row_word, col_word, w8 FROM p UNION ALL SELECT col_word, row_word, w8 FROM p) GROUP BY 1, 2""")
def c04_window_pairs(spark, d):
    """C4: sliding-window pair counts over documents, window 5 (closed form)."""
    return co.window_pairs(_doc_words(Tables(spark, d)), "w", 5)


@query("c05_window_share", f"""WITH p AS (SELECT * FROM {_pairs_sql(_CONV_W, 'conv_id, turn', 4, _C4_W)} WHERE w8 > 0),
m AS (SELECT row_word, col_word, sum(w8) AS weight FROM
  (SELECT row_word, col_word, w8 FROM p UNION ALL SELECT col_word, row_word, w8 FROM p) GROUP BY 1, 2)
SELECT row_word, col_word, round(weight / sum(weight) OVER (), 9) AS weight FROM m""")
def c05_window_share(spark, d):
    """Window-pair counts divided by their total (sums to 1)."""
    m = co.normalize_total(co.window_pairs(_conv_words(Tables(spark, d)), "w", 5))
    return m.select("row_word", "col_word", F.round("weight", 9).alias("weight"))


@query("c06_row_normalize", f"""WITH p AS (SELECT * FROM {_pairs_sql(_CONV_W, 'conv_id, turn', 2)} WHERE row_word <> col_word),
m AS (SELECT row_word, col_word, sum(w8) AS weight FROM
  (SELECT row_word, col_word, w8 FROM p UNION ALL SELECT col_word, row_word, w8 FROM p) GROUP BY 1, 2)
SELECT row_word, col_word, round(weight / sum(abs(weight)) OVER (PARTITION BY row_word), 6) AS l1,
  round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY row_word)), 6) AS l2 FROM m""")
def c06_row_normalize(spark, d):
    """l1 and l2 row normalization of the two-sided context matrix."""
    m = co.row_norms(co.two_sided(_conv_words(Tables(spark, d)), "w", 2))
    return m.select("row_word", "col_word", F.round("l1", R6).alias("l1"), F.round("l2", R6).alias("l2"))


_STOPS_SQL = q.STOPS


@query("c07_context_cloud", f"""WITH p AS (SELECT * FROM {_pairs_sql(_DOC_W, 'doc_id', 5)} WHERE row_word <> col_word),
m AS (SELECT row_word, col_word, sum(w8) AS weight FROM
  (SELECT row_word, col_word, w8 FROM p UNION ALL SELECT col_word, row_word, w8 FROM p) GROUP BY 1, 2),
n AS (SELECT row_word, col_word, weight / sum(abs(weight)) OVER (PARTITION BY row_word) AS weight FROM m),
ph AS (SELECT DISTINCT item_id, unnest({q.letters_only_words('text')}) AS word FROM benchmark),
sc AS (SELECT item_id, col_word, round(sum(weight), 6) AS score FROM n JOIN ph ON n.row_word = ph.word
WHERE NOT list_contains({_STOPS_SQL}, col_word) GROUP BY item_id, col_word)
SELECT * FROM (SELECT item_id, col_word, score,
  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, col_word) AS rank FROM sc) WHERE rank <= 10""")
def c07_context_cloud(spark, d):
    """Context cloud of every benchmark passage: summed l1-normalized
    rows of its words, stop words removed, top 10."""
    t = Tables(spark, d)
    m = co.two_sided(_doc_words(t), "w", 5)
    phrases = t.benchmark.select("item_id", F.explode(tx.letters_only_words("text")).alias("word"))
    return co.context_clouds(m, phrases, "item_id", ENGLISH_STOP_WORDS, 10, R6)


_CONV_VOCAB_SQL = f"""(SELECT token AS symbol, row_number() OVER (ORDER BY count(*) DESC, token DESC) - 1 AS idx
  FROM (SELECT unnest(w) AS token FROM {_CONV_W}) GROUP BY token)"""
_CONV_IDS_SQL = f"""(WITH t AS (SELECT conv_id, turn, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM {_CONV_W}),
  k AS (SELECT t.conv_id, t.turn, list(v.idx ORDER BY t.pos) AS ids FROM t JOIN {_CONV_VOCAB_SQL} v ON t.token = v.symbol
  GROUP BY t.conv_id, t.turn)
  SELECT conv_id, turn, coalesce(ids, CAST([] AS BIGINT[])) AS ids FROM conversations LEFT JOIN k USING (conv_id, turn))"""


@query("v19_pair_dataset", f"""WITH e AS {_CONV_IDS_SQL}, r AS (SELECT conv_id, turn, role FROM conversations)
SELECT a.conv_id, a.turn, md5(array_to_string(a.ids, ',')) AS ha, md5(array_to_string(b.ids, ',')) AS hb,
  CAST(ra.role = rb.role AS INTEGER) AS label
FROM e a JOIN e b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
JOIN r ra ON ra.conv_id = a.conv_id AND ra.turn = a.turn JOIN r rb ON rb.conv_id = b.conv_id AND rb.turn = b.turn""")
def v19_pair_dataset(spark, d):
    """Pair dataset: two encoded texts (turn t and t+1) plus a label
    (1 when both turns have the same role)."""
    t = Tables(spark, d)
    c = t.conversations.select("conv_id", "turn", "role", tx.letters_only_words("text").alias("w"))
    vocab = vb.frequency_vocabulary(vb.token_table(c, "w", ["conv_id", "turn"]))
    enc = vb.encode_arrays(c, "w", vocab, "ids", unk_idx=None, keys=["conv_id", "turn"])
    a = enc.select("conv_id", "turn", F.col("role").alias("ra"), F.col("ids").alias("ia"))
    b = enc.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("rb"), F.col("ids").alias("ib"))
    p = a.join(b, ["conv_id", "turn"])
    return p.select("conv_id", "turn", F.md5(ar.int_array_string("ia")).alias("ha"),
                    F.md5(ar.int_array_string("ib")).alias("hb"), (F.col("ra") == F.col("rb")).cast("int").alias("label"))


_WV_SQL = f"""(SELECT v.symbol AS word, CAST(e.embedding AS DOUBLE[]) AS vec
  FROM {_VOCAB_SQL} v JOIN embeddings e ON v.idx = e.vec_id)"""


@query("v20_expand_vectors", f"""WITH p AS (SELECT conv_id, turn,
    CASE WHEN len(w) >= 10 THEN w[len(w) - 9:] ELSE list_concat(repeat([''], 10 - len(w)), w) END AS w FROM {_CONV_W}),
t AS (SELECT conv_id, turn, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM p),
x AS (SELECT conv_id, turn, pos, coalesce(wv.vec, repeat([0.0], 64)) AS vec FROM t LEFT JOIN {_WV_SQL} wv ON t.token = wv.word)
SELECT conv_id, turn, CAST(len(flatten(list(vec ORDER BY pos))) AS INTEGER) AS n_features,
  round(list_sum(flatten(list(vec ORDER BY pos))), 6) AS s FROM x GROUP BY conv_id, turn""")
def v20_expand_vectors(spark, d):
    """Left-padded (10) token sequences expanded into one concatenated
    feature vector (10 x 64) from the word-vector table; zeros for pads and
    unknown words."""
    from wordlake.operators import relational as rl
    t = Tables(spark, d)
    words, vocab = _vocab_docs(t)
    e = t.embeddings.select(F.col("vec_id").alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    wv = vocab.join(e, "idx").select(F.col("symbol").alias("word"), "vec")
    c = _conv_words(t).select("conv_id", "turn", ar.pad_left("w", 10, "").alias("w"))
    toks = vb.token_table(c, "w", ["conv_id", "turn"])
    looked = rl.lookup_with_default(toks, wv, "token", "word", "vec", F.array_repeat(F.lit(0.0), 64))
    seq = vb.collect_sequence(looked, ["conv_id", "turn"], "pos", "vec", "vecs")
    flat = seq.select("conv_id", "turn", F.flatten("vecs").alias("f"))
    return flat.select("conv_id", "turn", F.size("f").alias("n_features"), F.round(ar.array_sum("f"), R6).alias("s"))
