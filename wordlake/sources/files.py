"""File sources and sinks (S1-S20) with explicit schemas.

No schema inference on the hot path; compression is chosen by extension
(``.gz``); files that Hadoop cannot decode by name (``.gzip``, ``.zip``)
are read as binary and decoded inside tasks (``mapInPandas``), one file per
task, never on the driver.
"""

from __future__ import annotations

import re
import io
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema, header: bool = True, limit: int | None = None,
             **options) -> DataFrame:
    """CSV with header and a fixed schema (timestamps parsed by the
    schema; ``timestampFormat`` may be given); optional row limit."""
    r = spark.read.schema(schema).option("header", header)
    for k, v in options.items():
        r = r.option(k, v)
    df = r.csv(path)
    return df.limit(limit) if limit is not None else df


def read_csv_escaped(spark: SparkSession, path: str, schema, header: bool = True) -> DataFrame:
    """Quote '"', backslash escape, multi-line values, malformed rows dropped."""
    return (spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", "\\")
            .option("multiLine", True).option("mode", "DROPMALFORMED").csv(path))


def read_token_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """S3: header-less rows 'id,tok1,tok2,...' of any length -> (id, tokens).

    A token in double quotes may hold the separator; a doubled quote stands
    for one. Empty fields at the end pad short rows and are dropped."""
    mark = re.escape(sep)
    fields = F.regexp_extract_all(F.concat(F.lit(sep), F.col("value")), F.lit(f'{mark}("(?:[^"]|"")*"|[^{mark}]*)'), 1)
    rows = spark.read.text(path).select(fields.alias("f"))
    plain = F.transform("f", lambda t: F.when(t.startswith('"'), F.replace(t.substr(F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(t))
    rows = rows.select(plain.alias("f"))
    last = F.coalesce(F.array_max(F.transform("f", lambda t, i: F.when(t != "", i + 1))), F.lit(1))
    return rows.select(F.col("f")[0].cast("long").alias("id"), F.slice("f", F.lit(2), last - 1).alias("tokens"))


def read_tsv_column(spark: SparkSession, path: str, index: int, name: str = "text") -> DataFrame:
    """Header-less TSV, one column by position."""
    df = spark.read.option("sep", "\t").option("header", False).option("quote", "").csv(path)
    return df.select(F.col(f"_c{index}").alias(name))


def read_pair_tsv(spark: SparkSession, path: str, split: str, a: int = 8, b: int = 9,
                  with_label: bool = True) -> DataFrame:
    """Pair dataset TSV: header skipped, guid = split-<col 0>, texts from
    columns a and b, label = last column (constant '0' for test files)."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    cols = df.columns
    label = F.col(cols[-1]) if with_label else F.lit("0")
    return df.select(F.concat_ws("-", F.lit(split), F.col(cols[0])).alias("guid"), F.col(cols[a]).alias("text_a"),
                     F.col(cols[b]).alias("text_b"), label.alias("label"))


def read_shards(spark: SparkSession, pattern: str, schema, where=None, header: bool = True) -> DataFrame:
    """One scan over a glob of (gzip) CSV shards, filtered; the
    union of shards is implicit."""
    df = spark.read.schema(schema).option("header", header).csv(pattern)
    return df.where(where) if where is not None else df


def read_gzip_named(spark: SparkSession, directory: str, suffix: str = ".gzip") -> DataFrame:
    """S7 / S20 for shards whose suffix Hadoop does not map to a codec:
    binary files filtered by suffix, gunzipped inside tasks -> text lines."""
    import gzip

    def decode(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for line in gzip.decompress(content).decode("utf-8").splitlines():
                    rows.append((path, line))
            yield pd.DataFrame(rows, columns=["path", "value"])

    b = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory)
    return b.select("path", "content").mapInPandas(decode, "path string, value string")


def read_zip_words(spark: SparkSession, path: str) -> DataFrame:
    """First member of a zip archive, whitespace-split words, with the
    archive size (``length``) for a size check."""
    import zipfile

    def unzip(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for p, content, n in zip(pdf["path"], pdf["content"], pdf["length"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    words = z.read(z.namelist()[0]).decode("utf-8").split()
                rows.extend((p, int(n), i, w) for i, w in enumerate(words))
            yield pd.DataFrame(rows, columns=["path", "length", "pos", "word"])

    b = spark.read.format("binaryFile").load(path)
    return b.select("path", "content", "length").mapInPandas(unzip, "path string, length long, pos long, word string")


def read_texts(spark: SparkSession, directory: str) -> DataFrame:
    """Every file of a directory as one row (path, text)."""
    return spark.read.text(directory, wholetext=True).select(F.col("_metadata.file_path").alias("path"),
                                                             F.col("value").alias("text"))


def read_word_vectors(spark: SparkSession, path: str, dim: int | None = None, last: bool = False) -> DataFrame:
    """Whitespace-separated word-vector text.

    S12 (dim None): word, then every number. S13 (dim given): the first
    ``dim`` numbers after the word; lines with a malformed number are
    skipped; for duplicate words the last line wins. S14 (last=True): the
    key is everything before the last ``dim`` fields (multi-word keys)."""
    lines = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("__line"))
    parts = F.split(F.trim(F.col("value")), r"\s+")
    n = F.size(parts)
    if dim is None:
        word, nums = parts[0], F.slice(parts, 2, n - 1)
    elif last:
        word, nums = F.array_join(F.slice(parts, 1, n - dim), " "), F.slice(parts, -dim, dim)
    else:
        word, nums = parts[0], F.slice(parts, 2, dim)
    vec = F.transform(nums, lambda x: x.try_cast("double"))
    out = lines.select(word.alias("word"), vec.alias("vec"), "__line", n.alias("__n"))
    if dim is not None:
        out = out.where((F.col("__n") >= dim + 1) & (F.size("vec") == dim) &
                        (F.size(F.filter("vec", lambda x: x.isNull())) == 0))
        out = out.groupBy("word").agg(F.max_by("vec", "__line").alias("vec"))
    return out.select("word", "vec")


def selective_vectors(vectors: DataFrame, vocab: DataFrame, dim: int) -> DataFrame:
    """Keep only vocabulary words; zeros where a word has no vector."""
    v = vectors.select(F.col("word").alias("__w"), "vec")
    return vocab.join(v, vocab["symbol"] == v["__w"], "left").select(
        "symbol", "idx", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))


# ------------------------------------------------------------------ sinks

_WRITERS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".txt": "text"}


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by extension (parquet, csv with header,
    JSON lines, text for a single string column). No index column."""
    fmt = _WRITERS.get(os.path.splitext(path)[1], "parquet")
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True).option("escape", "\\")
    getattr(w, fmt)(path)


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read by extension (JSON is supported, unlike the reference)."""
    fmt = _WRITERS.get(os.path.splitext(path)[1], "parquet")
    r = spark.read
    if schema is not None and fmt != "parquet":
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("escape", "\\")
    return getattr(r, fmt)(path)


def write_per_key_texts(df: DataFrame, key: str, text_col: str, path: str, min_rows: int = 2) -> None:
    """One text folder per key (Hive-style ``key=value``), only keys
    with at least ``min_rows`` rows. Key counts are a partial aggregate
    joined back (a skewed key is split by AQE's skew join, unlike a window)."""
    keep = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_rows).select(key)
    df.join(keep, key, "left_semi").select(key, text_col).write.mode("overwrite").partitionBy(key).text(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for derived files."""
    import uuid

    from wordlake.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


VECTOR_TEXT_SCHEMA = T.StructType([T.StructField("word", T.StringType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
