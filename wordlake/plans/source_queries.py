"""Registered source/sink queries (S1-S19): each writes data derived from a
driver table into a fresh folder under ``spark.checkpoint.dir`` with the
matching sink, reads it back with the source under test, and must equal
the SQL over the original table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordlake.functions import text as tx
from wordlake.plans import sqlfrag as q
from wordlake.plans.registry import Tables, query
from wordlake.sources import files as fs

R6 = 6
ORDER_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType())])


@query("s01_csv_header", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def s01_csv_header(spark, d):
    """CSV with header written and read back with a fixed schema."""
    path = fs.scratch_dir(spark, "s01") + "/orders.csv"
    fs.save_table(Tables(spark, d).orders, path)
    return fs.load_table(spark, path, ORDER_SCHEMA)


@query("s02_csv_escaped", "SELECT conv_id, turn, md5(text) AS h FROM conversations")
def s02_csv_escaped(spark, d):
    """Multi-line quoted text with backslash escapes round-trips."""
    path = fs.scratch_dir(spark, "s02")
    c = Tables(spark, d).conversations.select("conv_id", "turn", "text")
    c.write.option("header", True).option("quote", '"').option("escape", "\\").csv(path)
    schema = "conv_id long, turn long, text string"
    return fs.read_csv_escaped(spark, path, schema).select("conv_id", "turn", F.md5("text").alias("h"))


@query("s03_token_rows", f"""SELECT conv_id * 1000 + turn AS id, CAST(len(w) AS INTEGER) AS n_tokens,
  md5(array_to_string(w, ' ')) AS h FROM (SELECT conv_id, turn, {q.letters_only_words('text')} AS w FROM conversations)""")
def s03_token_rows(spark, d):
    """S3: header-less 'id,token,token,...' rows of any length."""
    path = fs.scratch_dir(spark, "s03")
    c = Tables(spark, d).conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                                              tx.letters_only_words("text").alias("w"))
    c.select(F.concat_ws(",", F.col("id").cast("string"), F.array_join("w", ","))).write.text(path)
    r = fs.read_token_rows(spark, path)
    return r.select("id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("h"))


@query("s04_csv_timestamps", "SELECT event_id, ts, value FROM events")
def s04_csv_timestamps(spark, d):
    """Timestamps (naive, microseconds) written and parsed by the schema."""
    path = fs.scratch_dir(spark, "s04")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    Tables(spark, d).events.select("event_id", "ts", "value").write.option("header", True) \
        .option("timestampNTZFormat", fmt).csv(path)
    return fs.read_csv(spark, path, "event_id long, ts timestamp_ntz, value double", timestampNTZFormat=fmt)


@query("s05_tsv_column", "SELECT md5(regexp_replace(text, '[\\t\\n]', ' ', 'g')) AS h FROM benchmark")
def s05_tsv_column(spark, d):
    """Header-less TSV, column 1 (author<TAB>quote)."""
    path = fs.scratch_dir(spark, "s05")
    b = Tables(spark, d).benchmark
    b.select(F.concat_ws("\t", F.col("item_id").cast("string"), F.regexp_replace("text", "[\t\n]", " "))).write.text(path)
    back = fs.read_tsv_column(spark, path, 1)
    return back.select(F.md5("text").alias("h"))


@query("s06_pair_tsv", """SELECT 'train-' || CAST(a.conv_id * 1000 + a.turn AS VARCHAR) AS guid,
  md5(regexp_replace(a.text, '[\\t\\n]', ' ', 'g')) AS ha, md5(regexp_replace(b.text, '[\\t\\n]', ' ', 'g')) AS hb,
  CAST(CAST(a.role = b.role AS INTEGER) AS VARCHAR) AS label
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def s06_pair_tsv(spark, d):
    """Pair TSV (id col 0, texts cols 8 and 9, label last), header skipped."""
    path = fs.scratch_dir(spark, "s06")
    c = Tables(spark, d).conversations.select("conv_id", "turn", "role",
                                              F.regexp_replace("text", "[\t\n]", " ").alias("text"))
    a = c.select("conv_id", "turn", F.col("role").alias("ra"), F.col("text").alias("ta"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("rb"), F.col("text").alias("tb"))
    p = a.join(b, ["conv_id", "turn"])
    filler = [F.lit("x").alias(f"f{i}") for i in range(1, 8)]
    rows = p.select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), *filler,
                    F.col("ta").alias("text_a"), F.col("tb").alias("text_b"),
                    (F.col("ra") == F.col("rb")).cast("int").cast("string").alias("label"))
    rows.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    r = fs.read_pair_tsv(spark, path, "train")
    return r.select("guid", F.md5("text_a").alias("ha"), F.md5("text_b").alias("hb"), "label")


@query("s07_gzip_shards", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def s07_gzip_shards(spark, d):
    """Gzip CSV shards read by one glob scan with a filter."""
    path = fs.scratch_dir(spark, "s07")
    Tables(spark, d).orders.repartition(8).write.option("header", True).option("compression", "gzip").csv(path)
    r = fs.read_shards(spark, f"{path}/part-*.csv.gz", ORDER_SCHEMA, F.col("o_orderstatus") == "F")
    return r.select("o_orderkey", "o_totalprice")


@query("s08_json_roundtrip", "SELECT doc_id, lang, source, n_chars FROM documents")
def s08_json_roundtrip(spark, d):
    """Save and load by extension (JSON lines)."""
    path = fs.scratch_dir(spark, "s08") + "/docs.json"
    fs.save_table(Tables(spark, d).documents.select("doc_id", "lang", "source", "n_chars"), path)
    return fs.load_table(spark, path, "doc_id long, lang string, source string, n_chars long")


@query("s18_parquet_checkpoint", "SELECT doc_id, md5(text) AS h FROM documents")
def s18_parquet_checkpoint(spark, d):
    """Binary checkpoint of a table (parquet) and its reload."""
    path = fs.scratch_dir(spark, "s18") + "/docs.parquet"
    fs.save_table(Tables(spark, d).documents.select("doc_id", "text"), path)
    return fs.load_table(spark, path).select("doc_id", F.md5("text").alias("h"))


@query("s19_per_key_texts", """SELECT conv_id, count(*) AS n_lines FROM conversations GROUP BY conv_id HAVING count(*) >= 2""")
def s19_per_key_texts(spark, d):
    """S19 + S9: one text folder per conversation with >= 2 turns, then every
    file read back whole (S9) and its lines counted."""
    path = fs.scratch_dir(spark, "s19")
    c = Tables(spark, d).conversations.select("conv_id", F.regexp_replace("text", "\n", " ").alias("line"))
    fs.write_per_key_texts(c, "conv_id", "line", path)
    t = fs.read_texts(spark, path)
    per_file = t.select(F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"),
                        F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("n"))
    return per_file.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_lines"))


@query("s12_word_vectors", """SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS INTEGER) AS dim,
  round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS s FROM embeddings""")
def s12_word_vectors(spark, d):
    """A word-vector text file (word then numbers) loaded back."""
    path = fs.scratch_dir(spark, "s12")
    e = Tables(spark, d).embeddings
    e.select(F.concat_ws(" ", F.col("vec_id").cast("string"),
                         F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " "))) \
        .write.text(path)
    v = fs.read_word_vectors(spark, path, 64)
    return v.select("word", F.size("vec").alias("dim"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@query("s12_all_numbers", """SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) - vec_id % 5 AS INTEGER) AS dim,
  round(list_sum(CAST(embedding[1:len(embedding) - vec_id % 5] AS DOUBLE[])), 4) AS s FROM embeddings""")
def s12_all_numbers(spark, d):
    """Every number of a line after its word, lines of different length."""
    path = fs.scratch_dir(spark, "s12_all")
    e = Tables(spark, d).embeddings
    numbers = F.expr("slice(embedding, 1, cast(size(embedding) - vec_id % 5 as int))")
    e.select(F.concat_ws(" ", F.col("vec_id").cast("string"),
                         F.array_join(F.transform(numbers, lambda x: x.cast("double").cast("string")), " "))) \
        .write.text(path)
    v = fs.read_word_vectors(spark, path)
    return v.select("word", F.size("vec").alias("dim"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))
