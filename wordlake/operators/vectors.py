"""Vector tables: lookup, normalization, text vectors, nearest neighbours,
SVD and word-vector training (E1-E14).

A vector table is ``(word, vec array<double>)``. Nearest-neighbour search
is in ``search``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.operators import blocks as bl
from wordlake.operators import sparse as sp
from wordlake.operators.ordering import global_index
from wordlake.operators.search import nearest  # noqa: F401
from wordlake.session import cut_lineage, drop_table


def zeros(dim: int):
    return F.array_repeat(F.lit(0.0), dim)


def as_double_vec(col) -> F.Column:
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def aligned_matrix(vocab: DataFrame, vectors: DataFrame, dim: int, zero_row: bool = True) -> DataFrame:
    """One vector per vocabulary index (zeros where the table has none);
    with ``zero_row`` an all-zero row 0 precedes indices starting at 1."""
    v = vectors.select(F.col("word").alias("__w"), F.col("vec"))
    m = vocab.join(v, vocab["symbol"] == v["__w"], "left").select(
        "idx", "symbol", F.coalesce("vec", zeros(dim)).alias("vec"), F.col("__w").isNotNull().cast("int").alias("hit"))
    if zero_row:
        z = vocab.sparkSession.range(1).select(F.lit(0).cast("long").alias("idx"), F.lit(None).cast("string")
                                               .alias("symbol"), zeros(dim).alias("vec"), F.lit(0).alias("hit"))
        m = m.where(F.col("idx") != 0).unionByName(z)
    return m


def compact_embedding(tokens: DataFrame, vectors: DataFrame, order_cols, dim: int):
    """Only corpus symbols present in the table, indexed from 1 by first
    appearance, row 0 = zeros; plus coverage = matched tokens / all tokens.
    Returns (matrix DataFrame (idx, symbol, vec), coverage DataFrame)."""
    words = vectors.select(F.col("word").alias("token"), "vec")
    first = tokens.groupBy("token").agg(F.min(F.struct(*order_cols)).alias("__f"))
    first = first.join(words.select("token"), "token", "left_semi").withColumnRenamed("token", "symbol")
    idx = global_index(first, [F.asc("__f")], "idx", 1).drop("__f")
    mat = idx.join(words.withColumnRenamed("token", "symbol"), "symbol")
    z = tokens.sparkSession.range(1).select(F.lit(0).cast("long").alias("idx"), F.lit("<UNK>").alias("symbol"),
                                            zeros(dim).alias("vec"))
    mat = mat.select("idx", "symbol", "vec").unionByName(z)
    # each symbol meets the table once, not each token
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(words.select("token", F.lit(True).alias("known")).distinct(), "token", "left")
    cov = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("matched")).withColumn(
        "coverage", F.try_divide(F.col("matched").cast("double"), F.col("total")))
    return mat, cov


def with_special_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Add <UNK> = 0s, <PAD> = 1s, <GO> = -1s; index by sorted word."""
    spark = vectors.sparkSession
    sp = spark.createDataFrame([("<UNK>", 0.0), ("<PAD>", 1.0), ("<GO>", -1.0)], "word string, fill double") \
        .select("word", F.array_repeat(F.col("fill"), dim).alias("vec"))
    allv = vectors.select("word", "vec").unionByName(sp)
    return global_index(allv, [F.asc("word")], "idx")


def normalize(vectors: DataFrame, col: str = "vec", out: str | None = None) -> DataFrame:
    """E5: l2-normalize (zero vectors stay zero). The norm is a column of its
    own, computed once per row rather than once per element."""
    n = vectors.withColumn("__norm", ar.l2_norm(col))
    return n.withColumn(out or col, F.transform(col, lambda x: F.when(F.col("__norm") == 0, F.lit(0.0))
                                                  .otherwise(x.cast("double") / F.col("__norm")))).drop("__norm")


#: Words of a block of texts, about.
BLOCK_CELLS = 1_000_000


def _word_blocks(terms: DataFrame, names: list[str]) -> DataFrame:
    """(names..., block, at, n, words) of (names..., word): blocks of about BLOCK_CELLS rows, cut where the rows are. A row
    says how often (``n``) a text has which (``at``) of the ``words`` in the first row of its block; written once."""
    def block_of(rows: pa.Table, block: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        columns = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        text = np.zeros(rows.num_rows, np.int64)
        for k in names:
            part = columns[k].dictionary_encode(null_encoding="encode")
            text = np.unique(text * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        word = columns["word"].dictionary_encode(null_encoding="encode")
        cell, n = np.unique(text * len(word.dictionary) + word.indices.to_numpy(zero_copy_only=False), return_counts=True)
        of, at = np.divmod(cell, len(word.dictionary))
        length = np.bincount(of)
        first = pa.array(np.unique(text, return_index=True)[1])
        lists = [bl.listed(length, pa.array(x.astype(np.int32))) for x in (at, n)]
        return pa.RecordBatch.from_arrays([*(columns[k].take(first) for k in names), pa.array(np.full(len(length), block)), *lists, bl.first_of(len(length), word.dictionary)],
                                          names=[*names, "block", "at", "n", "words"])

    def cut(batches):
        held, n, block = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_CELLS:
                yield block_of(pa.Table.from_batches(held), block)
                held, n, block = [], 0, block + 1
        if n:
            yield block_of(pa.Table.from_batches(held), block)

    kinds = "".join(f"{n} {terms.schema[n].dataType.simpleString()}, " for n in names)
    return cut_lineage(terms.mapInArrow(cut, f"{kinds}block long, at array<int>, n array<int>, words array<{terms.schema['word'].dataType.simpleString()}>"))


def _text_sums(tokens: DataFrame, vectors: DataFrame, keys: list[str], token_col: str, dim: int, fallback=None, scale: DataFrame | None = None) -> DataFrame:
    """(keys..., sums, weight) of every text: its words' vectors and weights, added up. A word weighs as often as it
    stands in the text, times its factor in ``scale`` (token, factor), which leaves out words it doesn't list.

    Texts are cut into blocks, a block gets each vector it needs once, so no vector travels for every text and word. A
    text may stand in several blocks."""
    names = [f"k{i}" for i in range(len(keys))]
    terms = _word_blocks(tokens.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(token_col).alias("word")), names)
    need = terms.where(F.size("words") > 0).select("block", F.explode("words").alias("word")).distinct()
    if scale is not None:
        need = need.join(scale.select(F.col("token").alias("word"), "factor"), "word")
    found = need.join(vectors.select("word", "vec"), "word", "left").withColumn("vec", F.coalesce("vec", fallback) if fallback is not None else F.col("vec"))
    exact = F.forall("vec", lambda x: x == x.cast("float").cast("double"))  # 4 bytes where they say the same
    found = found.select(F.col("block").alias("b"), F.col("word").alias("w"), *(["factor"] if scale is not None else []),
                         F.when(exact, F.col("vec").cast("array<float>")).alias("half"), F.when(F.coalesce(~exact, F.lit(True)), F.col("vec")).alias("full"))

    def add(cells: pa.Table, words: pa.Table) -> pa.Table:
        code = words.column("w").combine_chunks().dictionary_encode(null_encoding="encode")
        listed, code = code.dictionary, code.indices.to_numpy(zero_copy_only=False)
        x = np.zeros((len(listed), dim))
        for c in ("half", "full"):
            column = words.column(c).combine_chunks()
            np.add.at(x, code[column.is_valid().to_numpy(zero_copy_only=False)], column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        often = np.bincount(code, minlength=len(listed)).astype(float)  # a word may have several vectors
        if "factor" in words.column_names:
            factor = np.zeros(len(listed))
            factor[code] = words.column("factor").to_numpy()
        else:
            factor = np.ones(len(listed))
        text = np.zeros(cells.num_rows, np.int64)
        for k in names:
            part = cells.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            text = np.unique(text * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        row = np.repeat(np.arange(cells.num_rows), pc.list_value_length(cells.column("at")).to_numpy())
        place = pc.index_in(cells.column("words").combine_chunks().flatten(), value_set=listed).fill_null(-1).to_numpy(zero_copy_only=False)
        at = place[cells.column("at").combine_chunks().flatten().to_numpy()]
        n = cells.column("n").combine_chunks().flatten().to_numpy().astype(float)
        row, at, n = row[at >= 0], at[at >= 0], n[at >= 0]
        text = text[row]
        order = np.argsort(text, kind="stable")
        text, row, at, n = text[order], row[order], at[order], n[order]
        first = np.flatnonzero(np.diff(text, prepend=-1))
        weight = n * factor[at]
        total = np.zeros((len(first), dim))
        for lo in range(0, len(text), 1 << 16):
            t = text[lo : lo + (1 << 16)]
            starts = np.flatnonzero(np.diff(t, prepend=-1))
            total[t[starts]] += np.add.reduceat(x[at[lo : lo + len(t)]] * weight[lo : lo + len(t), None], starts)
        keyed = {k: cells.column(k).combine_chunks().take(pa.array(row[first])) for k in names}
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), dim).cast(pa.list_(pa.float64()))
        return pa.table({**keyed, "sums": sums, "weight": np.bincount(text, weight * often[at], len(first))})

    kinds = ", ".join(f"{n} {terms.schema[n].dataType.simpleString()}" for n in names)
    parts = terms.groupBy("block").cogroup(found.groupBy("b")).applyInArrow(add, f"{kinds}, sums array<double>, weight double")
    whole = parts.groupBy(*names).agg(Summarizer.sum(array_to_vector("sums")).alias("sums"), F.sum("weight").alias("weight"))
    return whole.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], vector_to_array("sums").alias("sums"), "weight")


def text_vectors(tokens: DataFrame, vectors: DataFrame, key, dim: int, token_col: str = "token",
                 fallback=None, normalize_out: bool = True) -> DataFrame:
    """Text vector = mean of its token vectors (misses use ``fallback``,
    zeros by default), then l2-normalized. The sums are taken per block of
    texts (`_text_sums`), not by an explode per dimension."""
    keys = [key] if isinstance(key, str) else list(key)
    out = _means(_text_sums(tokens, vectors, keys, token_col, dim, fallback), keys)
    return normalize(out) if normalize_out else out


def _means(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(*keys, F.transform("sums", lambda x: x / F.col("weight")).alias("vec"))


def weighted_text_vectors(tokens: DataFrame, vectors: DataFrame, key, dim: int, token_col: str = "token", a: float = 1e-3,
                          common: int = 1, fallback=None) -> DataFrame:
    """E9 with frequency weights: a word of corpus share p weighs a / (a + p) (Arora, Liang and Ma, 2017); then the
    ``common`` first directions of all texts, by power iteration on the dim x dim matrix of their products, are taken
    out, and what is left is l2-normalized. Corpus counts are one aggregate; only that matrix reaches the driver."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = tokens.groupBy(F.col(token_col).alias("token")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    total = counts.agg(F.sum("c").alias("all"))  # one row
    scale = counts.crossJoin(F.broadcast(total)).select("token", (F.lit(a) / (a + F.col("c") / F.col("all"))).alias("factor"))
    rows = _means(_text_sums(tokens, vectors, keys, token_col, dim, fallback, scale), keys)
    if not common:
        return normalize(rows)
    rows = cut_lineage(rows)
    basis = power_directions(row_products(rows, "vec", dim), common)
    for j in range(basis.shape[1]):
        way = F.array(*[F.lit(float(x)) for x in basis[:, j]])
        rows = rows.withColumn("__s", ar.dot("vec", way)).withColumn(
            "vec", F.zip_with("vec", way, lambda x, y: x - F.col("__s") * y)).drop("__s")
    return normalize(rows)


def row_products(rows: DataFrame, vec_col: str, dim: int) -> np.ndarray:
    """Sum of x x^T over all rows: one dim x dim matrix a partition to the driver."""
    def partial(batches):
        g = np.zeros((dim, dim))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()])], names=["g"])

    parts = rows.select(vec_col).mapInArrow(partial, "g binary").collect()
    return sum((np.frombuffer(r.g).reshape(dim, dim) for r in parts), np.zeros((dim, dim)))


def power_directions(products: np.ndarray, k: int, tolerance: float = 1e-12, most: int = 10_000) -> np.ndarray:
    """The first k eigenvectors (columns) of a symmetric matrix by power iteration and deflation."""
    left, out = products.copy(), []
    for _ in range(min(k, len(products))):
        x = left @ np.linspace(1, 2, len(left))
        for _ in range(most):
            size = np.linalg.norm(x)
            if size == 0:
                break
            y = left @ (x / size)
            done = np.linalg.norm(y - x * (x @ y) / size ** 2) <= tolerance * max(np.linalg.norm(y), 1e-300)
            x = y
            if done:
                break
        size = np.linalg.norm(x)
        if size == 0:
            break
        out.append(x / size)
        left = left - np.outer(out[-1], out[-1]) * (out[-1] @ left @ out[-1])
    return np.array(out).T if out else np.zeros((len(products), 0))


def similarity(vectors: DataFrame, a: str, b: str) -> DataFrame:
    """Dot product of two words' vectors."""
    va = vectors.where(F.col("word") == a).select(F.col("vec").alias("a"))
    vb_ = vectors.where(F.col("word") == b).select(F.col("vec").alias("b"))
    return va.crossJoin(vb_).select(ar.dot("a", "b").alias("similarity"))


def label_centroids(vectors: DataFrame, label_col: str, vec_col: str = "vec") -> DataFrame:
    """Mean vector per label (Summarizer), l2-normalized: (label, vec)."""
    m = vectors.groupBy(label_col).agg(Summarizer.mean(array_to_vector(vec_col)).alias("__m"))
    return normalize(m.select(label_col, vector_to_array("__m").alias("vec")))


def svd(rows: DataFrame, vec_col: str, k: int, compute_u: bool = False, key: str | None = None):
    """Truncated SVD with mllib's distributed RowMatrix (Gramian or
    ARPACK, mat-vec products distributed). Returns (s list, V numpy, U
    DataFrame or None); U rows keep their key when ``key`` is given."""
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix
    from pyspark.mllib.util import MLUtils

    index = F.lit(0) if key is None else F.col(key)
    dense = rows.select(index.cast("long").alias("index"), array_to_vector(vec_col).alias("vector"))
    mat = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(dense, "vector"))
    res = mat.computeSVD(k, computeU=compute_u)
    s = res.s.toArray().tolist()
    v = res.V.toArray()
    u = None
    if compute_u:
        u = res.U.rows.map(lambda r: (int(r.index), [float(x) for x in r.vector.toArray()])) \
            .toDF(["key" if key is None else key, "u"])
    return s, v, u


def project(rows: DataFrame, vec_col: str, basis, out: str = "coords") -> DataFrame:
    """Coordinates on given basis vectors (columns of ``basis``),
    the small basis travelling inside the expression."""
    cols = [[float(x) for x in basis[:, j]] for j in range(basis.shape[1])]
    coords = [ar.dot(vec_col, F.array(*[F.lit(x) for x in c])) for c in cols]
    return rows.withColumn(out, F.array(*coords))


def _both_packed(triples: DataFrame, row_idx: str, col_idx: str, value: str, symmetric: bool, blocks: int, tasks: int):
    """The packed cells of the matrix and of its transpose."""
    m = triples.select(F.col(row_idx).cast("long").alias("r"), F.col(col_idx).cast("long").alias("c"), F.col(value).cast("double").alias("w"))
    if not symmetric:
        m = cut_lineage(m)  # read twice
    cells = sp.packed(m, blocks, tasks)
    back = cells if symmetric else sp.packed(m.select("c", "r", "w"), blocks, tasks)
    return cells, back


def sparse_svd(triples: DataFrame, row_idx: str, col_idx: str, value: str, k: int, size: int, symmetric: bool = False,
               extra: int = 10, tolerance: float = 1e-7, most: int = 100, tasks: int | None = None, pieces=None):
    """E11 on a sparse (row, col, value) matrix of any width, rows and columns
    numbered from 0 to ``size`` - 1: block power iterations by the blocked
    products of `sparse`. A matrix that is not ``symmetric`` is packed by rows
    too, for the products with its transpose. The driver holds only the Gram
    matrices of the k + ``extra`` columns. Repeats until the k singular values
    change by at most ``tolerance`` of the first, or ``most`` times. A table
    of the iteration is deleted when the next is written. ``pieces``, a function of the number of blocks, gives the
    packed cells of a symmetric matrix in place of ``triples``.
    Returns (s, rows (row, vec) with vec = u * s, 0 for a row without a cell;
    rows may be left out if their block has none)."""
    spark, width = SparkSession.active(), k + extra
    tasks = tasks or max(2, spark.sparkContext.defaultParallelism)
    blocks = sp.block_count(size, tasks)
    if pieces:
        cells = back = sp.gathered(pieces(blocks), tasks)
    else:
        cells, back = _both_packed(triples, row_idx, col_idx, value, symmetric, blocks, tasks)

    def spectrum(y):
        value, way = np.linalg.eigh(sp.gram(y, width))
        return np.sqrt(np.maximum(value[::-1], 0)), way[:, ::-1]

    def orthonormal(y, s, way):
        return sp.times(y, way * np.where(s > 1e-7 * max(s[0], 1e-300), 1 / np.maximum(s, 1e-300), 0))

    def turned(by, x, former):
        y = sp.product(by, x, width, blocks, size, tasks)
        if former is not None:
            drop_table(former)
        return y

    start = sp.started(spark, width, blocks, size)
    q, last, z = orthonormal(start, *spectrum(start)), None, None
    for _ in range(most):
        y = turned(cells, q, z)
        s, way = spectrum(y)
        if last is not None and np.abs(s[:k] - last).max() <= tolerance * s[0]:
            break
        last = s[:k]
        z = turned(back, orthonormal(y, s, way), y)
        q = orthonormal(z, *spectrum(z))
    cells.unpersist()
    back.unpersist()
    return s[:k].tolist(), sp.listed(sp.times(y, np.ascontiguousarray(way[:, :k])), k, blocks)


def train_word2vec(sentences: DataFrame, col: str, dim: int = 30, min_count: int = 5, window: int = 5,
                   seed: int = 42, max_iter: int = 1):
    """Skip-gram word vectors with pyspark.ml Word2Vec."""
    from pyspark.ml.feature import Word2Vec

    w2v = Word2Vec(vectorSize=dim, minCount=min_count, windowSize=window, seed=seed, maxIter=max_iter,
                   inputCol=col, outputCol="__w2v", numPartitions=max(1, sentences.rdd.getNumPartitions()))
    model = w2v.fit(sentences.select(col))
    vecs = model.getVectors().select("word", vector_to_array("vector").alias("vec"))
    return model, vecs


def lookup(df: DataFrame, index_col: str, table: DataFrame, key: str, vec: str) -> DataFrame:
    """``df`` with the vector (as doubles) of the index in each row; an empty vector when the table lacks it."""
    v = table.select(F.col(key).alias("__k"), F.col(vec).cast("array<double>").alias(vec))
    j = df.join(v, F.col(index_col) == F.col("__k"), "left").drop("__k")
    return j.withColumn(vec, F.coalesce(vec, F.array().cast("array<double>")))
