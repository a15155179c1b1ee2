"""Registered language, UDF-surface and streaming queries (T11 exact, T17,
T18, X1/X6, 2.12 streaming smoke)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordlake.functions import text as tx
from wordlake.functions import udfs
from wordlake.operators import dataset as ds
from wordlake.operators import language as lg
from wordlake.plans import sqlfrag as q
from wordlake.plans.registry import Tables, query
from wordlake.sources import files as fs
from wordlake.streaming import rowwise as rw


def _profiles(t):
    """Profiles trained on the 80 % hash-split training part of documents."""
    d = ds.hash_split(t.documents.select("doc_id", "text", "lang"), "doc_id", 21, 0.8)
    return lg.train_profiles(d.where(F.col("split") == "train"), "text", "lang")


@query("t17_language")
def t17_language(spark, d):
    """Trigram-profile language detection of every document, with the
    labelled language for comparison (profiles from the training split)."""
    t = Tables(spark, d)
    det = lg.detect(t.documents.select("doc_id", "text"), "doc_id", "text", _profiles(t))
    return det.join(t.documents.select("doc_id", "lang"), "doc_id")


@query("t17_language_accuracy")
def t17_language_accuracy(spark, d):
    """T17 evaluation: detection accuracy on the held-out split, per language."""
    t = Tables(spark, d)
    s = ds.hash_split(t.documents.select("doc_id", "text", "lang"), "doc_id", 21, 0.8).where(F.col("split") == "test")
    det = lg.detect(s.select("doc_id", "text"), "doc_id", "text", _profiles(t)).join(s.select("doc_id", "lang"), "doc_id")
    return det.groupBy("lang").agg(F.avg((F.col("lang_detected") == F.col("lang")).cast("double")).alias("accuracy"),
                                   F.count(F.lit(1)).alias("n"))


@query("t18_language_fallback")
def t18_language_fallback(spark, d):
    """English test with fallback: page title, then body text, then URL."""
    t = Tables(spark, d)
    p = t.pages.select("page_id", F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"),
                       tx.html_to_text(F.regexp_replace("html", r"(?is)<title>.*?</title>", "")).alias("body"),
                       F.col("url"))
    det = lg.detect_with_fallback(p, "page_id", ["title", "body", "url"], _profiles(t))
    return det.withColumn("is_en", (F.col("lang_detected") == "en").cast("int"))


@query("t11_html_exact")
def t11_html_exact(spark, d):
    """T11 exact mode (X1/X6): the standard HTML parser in an Arrow-batched
    pandas UDF, next to the regex form for comparison."""
    p = Tables(spark, d).pages
    ex = udfs.dispatch("html_exact", "html")
    rx = udfs.dispatch("html_regex", "html")
    return p.select("page_id", F.length(ex).alias("n_exact"), F.length(rx).alias("n_regex"))


@query("st01_stream_clean", f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_kept, md5(array_to_string(w, ' ')) AS h
FROM (SELECT doc_id, {q.clean_words('text')} AS w FROM documents)""")
def st01_stream_clean(spark, d):
    """2.12: the row-wise cleaner (T1-T3) over a file stream of documents,
    drained with availableNow into a parquet sink, then read back."""
    schema = Tables(spark, d).documents.schema
    base = fs.scratch_dir(spark, "st01")
    path = f"{d.rstrip('/')}/documents.parquet"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    stream = rw.file_stream(spark, path, schema) if folder else rw.file_stream(spark, d, schema, glob="documents.parquet")

    def clean(s):
        w = tx.clean_words("text")
        return s.select("doc_id", F.size(w).alias("n_kept"), F.md5(F.array_join(w, " ")).alias("h"))

    rw.run_available(stream, clean, base + "/out", base + "/ckpt")
    return spark.read.parquet(base + "/out")
