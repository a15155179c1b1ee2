"""Registered queries: stemming, selections, index lookups, sub-token labels, prediction files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.functions import table_functions as tf
from wordlake.functions import text as tx
from wordlake.functions import udfs
from wordlake.operators import relational as rel
from wordlake.operators import stemming as sm
from wordlake.operators import vectors as ve
from wordlake.operators import wordpieces as wp
from wordlake.plans import sqlfrag as q
from wordlake.plans.registry import Tables, query
from wordlake.sources import archives as ac
from wordlake.sources import files as fs


@query("t04_clean_stem")
def t04_clean_stem(spark, d):
    """T4: the full cleaner (T1 -> T2 -> T3 -> stem -> join) of every document."""
    docs = sm.clean_and_stem(Tables(spark, d).documents, "doc_id", "text")
    return docs.select("doc_id", F.md5("stems").alias("h"), F.length("stems").alias("n_chars"))


@query("t09_stems")
def t09_stems(spark, d):
    """The stem of every distinct word of the documents."""
    return sm.stem_words(Tables(spark, d).documents.select(F.explode(tx.letters_only_words("text")).alias("token")).distinct())


@query("s10_selected_sources", "SELECT doc_id, source, md5(text) AS h FROM documents WHERE source IN ('src0', 'src1', 'src10')")
def s10_selected_sources(spark, d):
    """Raw texts of chosen parts of a corpus (the filter is pushed to the scan)."""
    docs = rel.select_keys(Tables(spark, d).documents, "source", ["src0", "src1", "src10"])
    return docs.select("doc_id", "source", F.md5("text").alias("h"))


_ENDS_SQL = f"""WITH f AS (SELECT token, count(*) AS freq FROM (SELECT unnest({q.letters_only_words('text')}) AS token FROM documents) GROUP BY token)"""


@query("a11_frequent_symbols", f"""{_ENDS_SQL}
SELECT * FROM (SELECT 'most' AS part, token, freq FROM f ORDER BY freq DESC, token LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'least' AS part, token, freq FROM f ORDER BY freq, token LIMIT 10)""")
def a11_frequent_symbols(spark, d):
    """The 10 most and the 10 least frequent symbols of the corpus."""
    f = Tables(spark, d).documents.select(F.explode(tx.letters_only_words("text")).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))
    most = f.orderBy(F.desc("freq"), "token").limit(10).select(F.lit("most").alias("part"), "token", "freq")
    return most.unionByName(f.orderBy("freq", "token").limit(10).select(F.lit("least").alias("part"), "token", "freq"))


@query("e04_index_lookup", """SELECT event_id, CAST(coalesce(len(embedding), 0) AS INTEGER) AS dim,
  round(coalesce(list_sum(CAST(embedding AS DOUBLE[])), 0), 4) AS s FROM events LEFT JOIN embeddings ON vec_id = user_id""")
def e04_index_lookup(spark, d):
    """Index -> vector, here the vector of each event's user index (an empty vector when the table has none)."""
    t = Tables(spark, d)
    v = ve.lookup(t.events.select("event_id", "user_id"), "user_id", t.embeddings, "vec_id", "embedding")
    return v.select("event_id", F.size("embedding").alias("dim"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@query("v18_piece_labels", f"""SELECT item_id, CAST(list_sum(list_transform(w, lambda x: CAST(ceil(length(x) / 3.0) AS INTEGER))) AS BIGINT) AS n_pieces,
  array_to_string(flatten(list_transform(w, lambda x: list_transform(generate_series(1, CAST(ceil(length(x) / 3.0) AS INTEGER)),
    lambda i: CAST(i = CAST(ceil(length(x) / 3.0) AS INTEGER) AS INTEGER)))), '') AS labels
FROM (SELECT item_id, {q.letters_only_words('text')} AS w FROM benchmark) WHERE len(w) > 0""")
def v18_piece_labels(spark, d):
    """Word-end labels of characters carried to sub-tokens of up to three characters: a piece has the label of
    its last character, found by the offset of its end."""
    b = Tables(spark, d).benchmark.select("item_id", tx.letters_only_words("text").alias("w")).where(F.size("w") > 0)
    b = b.select("item_id", F.regexp_extract_all(F.array_join("w", " "), F.lit("[^ ]{1,3}"), F.lit(0)).alias("pieces"), ar.word_end_labels("w").alias("marks"))
    b = b.withColumn("labels", ar.piece_labels("pieces", "marks"))
    return b.select("item_id", F.size("labels").cast("long").alias("n_pieces"), ar.int_array_string("labels", "").alias("labels"))


@query("k09_prediction_file", "SELECT doc_id AS test_id, round(least(1.0, n_chars / 4000.0), 6) AS score FROM documents")
def k09_prediction_file(spark, d):
    """K9: a prediction file (test_id, score) with header, written and read back; the score is a length rule."""
    path = fs.scratch_dir(spark, "k09") + "/predictions.csv"
    score = F.round(F.least(F.lit(1.0), F.col("n_chars") / 4000.0), 6)
    fs.save_table(Tables(spark, d).documents.select(F.col("doc_id").alias("test_id"), score.alias("score")), path)
    return fs.load_table(spark, path, "test_id long, score double")


def _in_reach(rows: pd.DataFrame) -> pd.Series:
    return ((rows["lang"] == "en") & (rows["n_chars"] >= 500)).astype("int32")


@query("x02_row_function", "SELECT doc_id, CAST(lang = 'en' AND n_chars >= 500 AS INTEGER) AS hit FROM documents")
def x02_row_function(spark, d):
    """A function of several columns of a row, on Arrow batches."""
    hit = udfs.row_function(_in_reach, "int")
    return Tables(spark, d).documents.select("doc_id", hit(F.struct("lang", "n_chars")).alias("hit"))


# Pieces: all words of 20 or more occurrences, their first 1 to 3 characters, and their last 1 to 3 as continuations.
_FREQUENT_SQL = f"""(SELECT word FROM (SELECT unnest({q.letters_only_words('text')}) AS word FROM documents) GROUP BY word HAVING count(*) >= 20)"""
_PIECES_SQL = f"""(SELECT word AS piece FROM {_FREQUENT_SQL} UNION SELECT substr(word, 1, k) FROM {_FREQUENT_SQL}, (SELECT unnest([1, 2, 3]) AS k)
  UNION SELECT '##' || substr(word, greatest(length(word) - k + 1, 1)) FROM {_FREQUENT_SQL}, (SELECT unnest([1, 2, 3]) AS k))"""


def _pieces(t):
    words = t.documents.select(F.explode(tx.letters_only_words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 20")
    first = [F.substring("word", 1, k) for k in (1, 2, 3)]
    last = [F.concat(F.lit(wp.JOINT), F.substring(F.col("word"), F.greatest(F.char_length("word") - (k - 1), F.lit(1)), F.lit(k))) for k in (1, 2, 3)]
    return words.select(F.explode(F.array("word", *first, *last)).alias("piece")).distinct()


@query("v18_word_pieces", f"""WITH RECURSIVE p AS MATERIALIZED {_PIECES_SQL},
w AS MATERIALIZED (SELECT DISTINCT word FROM (SELECT unnest({q.letters_only_words('text')}) AS word FROM benchmark)),
step(word, p0, n) AS (SELECT word, 0, 0 FROM w UNION ALL
  SELECT word, p0 + coalesce((SELECT max(k) FROM (SELECT unnest(generate_series(1, length(word) - p0)) AS k)
    WHERE (CASE WHEN p0 > 0 THEN '##' ELSE '' END || substr(word, p0 + 1, k)) IN (SELECT piece FROM p)), 100000), n + 1
  FROM step WHERE p0 < length(word)),
cut AS (SELECT word, CASE WHEN max(p0) > length(word) THEN 1 ELSE max(n) END AS n, CAST(max(p0) > length(word) AS INTEGER) AS unknown FROM step GROUP BY word),
o AS (SELECT item_id, i, cut.n, unknown FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT item_id, {q.letters_only_words('text')} AS w FROM benchmark)) JOIN cut USING (word))
SELECT b.item_id, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS n_pieces, CAST(coalesce(sum(unknown), 0) AS BIGINT) AS n_unknown,
  coalesce(string_agg(repeat('0', CAST(o.n - 1 AS BIGINT)) || '1', '' ORDER BY i), '') AS labels
FROM benchmark b LEFT JOIN o USING (item_id) GROUP BY b.item_id""")
def v18_word_pieces(spark, d):
    """Greedy longest-match pieces over a vocabulary trie (unknown words are one piece) and the word-end label of
    each piece's last character."""
    t = Tables(spark, d)
    rows = wp.piece_labels(t.benchmark.select("item_id", tx.letters_only_words("text").alias("w")), "w", "item_id", _pieces(t))
    return rows.select("item_id", F.size("tokens").cast("long").alias("n_pieces"),
                       F.size(F.filter("tokens", lambda x: x == wp.UNKNOWN)).cast("long").alias("n_unknown"), ar.int_array_string("labels", "").alias("labels"))


@query("x04_turn_windows", """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS start,
  md5(w1) AS w1, md5(w2) AS w2, md5(w3) AS w3 FROM (SELECT conv_id, turn, text AS w1, lead(text, 1) OVER c AS w2, lead(text, 2) OVER c AS w3,
  lead(turn, 2) OVER c AS last FROM conversations WINDOW c AS (PARTITION BY conv_id ORDER BY turn)) WHERE last IS NOT NULL""")
def x04_turn_windows(spark, d):
    """A table function with a table argument: all three consecutive turns of every conversation."""
    w = tf.windows(Tables(spark, d).conversations, "conv_id", "turn", "text", 3)
    return w.select("conv_id", "start", *(F.md5(f"w{i}").alias(f"w{i}") for i in (1, 2, 3)))


@query("s15_zip_words", """SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')) AS word
  FROM benchmark) WHERE word <> '' GROUP BY word""")
def s15_zip_words(spark, d):
    """Texts in zip archives, one a partition; whitespace-separated words of each first member, streamed and counted."""
    path = fs.scratch_dir(spark, "s15")
    ac.write_shards(Tables(spark, d).benchmark, "text", path, ".zip", 4)
    words = ac.read_archive(spark, path, ".zip", unit="word")
    return words.groupBy(F.col("value").alias("word")).agg(F.count("*").alias("n"))


@query("s20_gzip_suffix", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def s20_gzip_suffix(spark, d):
    """Shards with the suffix .gzip, one per partition of the table's scan, found by suffix and streamed."""
    path = fs.scratch_dir(spark, "s20")
    orders = Tables(spark, d).orders
    files = max(2, orders.rdd.getNumPartitions())
    ac.write_shards(orders.select(F.to_csv(F.struct("o_orderkey", "o_orderstatus")).alias("line")), "line", path, ".gzip", files)
    rows = ac.read_archive(spark, path, ".gzip").select(F.from_csv("value", "o_orderkey long, o_orderstatus string").alias("r")).select("r.*")
    return rows.where("o_orderstatus = 'F'")


@query("s14_selected_vectors", """SELECT symbol, CAST(len(e.embedding) AS INTEGER) AS dim, round(list_sum(CAST(e.embedding AS DOUBLE[])), 4) AS s
FROM (SELECT source || ' no ' || min(doc_id) AS symbol, min(doc_id) AS k FROM documents GROUP BY source, lang) JOIN embeddings e ON vec_id = k
UNION SELECT 'absent word', 64, 0.0""")
def s14_selected_vectors(spark, d):
    """A vector file with keys of several words; only the vocabulary is kept, zeros for what the file lacks. The
    vocabulary: one key per source and language, and one that no file has."""
    t = Tables(spark, d)
    path = fs.scratch_dir(spark, "s14")
    named = t.documents.select("source", "doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    numbers = F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), " ")
    named.select(F.concat_ws(" ", "source", F.lit("no"), F.col("doc_id").cast("string"), numbers)).write.text(path)
    firsts = t.documents.groupBy("source", "lang").agg(F.min("doc_id").alias("k")).join(t.embeddings.select(F.col("vec_id").alias("k")), "k", "left_semi")
    vocab = firsts.select(F.concat_ws(" ", "source", F.lit("no"), F.col("k").cast("string")).alias("symbol"), F.col("k").alias("idx")).distinct()
    vocab = vocab.unionByName(spark.range(1).select(F.lit("absent word").alias("symbol"), F.lit(-1).cast("long").alias("idx")))
    v = fs.selective_vectors(fs.read_word_vectors(spark, path, 64, last=True), vocab, 64)
    return v.select("symbol", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))
