"""The pipeline's stages against plain definitions, each on its own input."""

import hashlib
import uuid
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tests.llm import test_jaccard, test_rowwise, test_suffix
from wordlake.llm.mixing import mix_sources
from wordlake.llm.quality import quality_rules
from wordlake.llm.queries import BUDGET_SHARE, MAX_EPOCHS, WEIGHTS
from wordlake.session import checkpoint_dir


@pytest.fixture(scope="module")
def outputs(spark):
    docs, found = spark.read.parquet(f"{SF001}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        path = f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"
        stage(spark, docs, SF001).write.parquet(path)
        found.append((docs, spark.read.parquet(path)))
        docs = found[-1][1]
    return found


def test_stages(spark, outputs):
    columns = spark.read.parquet(f"{SF001}/documents.parquet").dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "source mixing", "byte-level BPE"]
    for _, out in outputs[:-1]:
        assert out.dtypes == columns
    source, out = outputs[0]
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in quality_rules(source).where("kept").collect())
    source, out = outputs[1]
    rows = [(r.doc_id, r.text) for r in source.collect()]
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, _, c in test_jaccard.brute(rows) if d == c)
    source, out = outputs[2]
    want = {d: (n - gone, sha) for d, n, gone, _, sha in test_suffix.brute([(r.doc_id, r.text) for r in source.collect()])}
    for r in out.collect():
        size, sha = want.pop(r.doc_id)
        raw = r.text.encode()
        assert hashlib.sha256(raw).hexdigest() == sha or 0 <= size - len(raw) <= 6 * 50  # halves of cut characters
        assert r.n_chars == len(r.text) or size == len(raw)
    assert not want
    source, out = outputs[3]
    parts = {r.doc_id: r for r in mix_sources(source, WEIGHTS, BUDGET_SHARE, MAX_EPOCHS).collect()}
    texts = {r.doc_id: r.text for r in source.collect()}
    copies = Counter()
    for r in out.collect():
        copies[r.doc_id] += len(test_rowwise.WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text)
    assert all(copies[d] == p.total_tokens for d, p in parts.items())
    source, out = outputs[4]
    enc = test_rowwise.encoding()
    want = Counter((r.doc_id, len(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in source.collect())
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in out.collect()) == want


def test_run(spark, outputs):
    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, SF001)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.exceptAll(outputs[-1][1]).count() == 0


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    long = docs.withColumn("text", F.concat_ws(" ", "text", F.lit(" ".join(f"w{i}x{i * 7 % 101}" for i in range(90)))))
    for frame in (docs, no_docs.select(docs.columns), docs.unionByName(long)):
        for _, stage in corpus_pipeline.STAGES:
            path = f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"
            stage(spark, frame, SF001).write.parquet(path)
            if stage is not corpus_pipeline.encode:
                frame = spark.read.parquet(path)
                assert frame.columns == docs.columns


def test_near_copies_are_decided_row_by_row(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(120))
    a, b, c, d = (text(k) for k in "abcd")
    rows = [(1, a), (2, a + " more"), (2, b), (5, c), (5, c + " more"), (6, c), (None, d), (None, d + " more"), (None, a + " end"), (7, ""), (7, ""), (8, None)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF001).collect()
    groups = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:1]) for r in got)
    assert groups == [(False, 1, "a"), (False, 2, "b"), (False, 5, "c"), (False, 7, ""), (False, 8, ""), (True, 0, "d")]


def test_kept_documents_are_not_exchanged(spark):
    """Only documents that may be dropped take part in the join with the dropped ones."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000)).unionByName(docs.limit(3))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_copies(spark, docs, SF001)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftSemi" not in plan and "Join LeftAnti" in plan
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        ids = sorted({d for d, _, c in test_jaccard.brute(rows) if d == c})
        assert sorted(r.doc_id for r in out.collect()) == ids
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
