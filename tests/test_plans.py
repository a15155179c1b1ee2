"""The modules of registered queries: no name is bound twice, every feature a query asks for exists."""

import ast
import pathlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from wordlake import plans
from wordlake.operators import models as md
from wordlake.plans import model_queries as mq
from wordlake.plans.registry import Tables

MODULES = sorted(pathlib.Path(plans.__file__).parent.glob("*.py"))


@pytest.mark.parametrize("path", MODULES, ids=lambda p: p.stem)
def test_no_function_hides_another(path):
    names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef))
    assert [n for n, c in names.items() if c > 1] == []


def test_event_features_are_there(spark, tmp_path):
    spark.sql("""SELECT id AS event_id, timestamp_seconds(id * 7000) AS ts, id % 5 AS user_id, 'a' AS event_type, id * 1.5D AS value,
        IF(id % 3 = 0, NULL, '{"k": 4}') AS props FROM range(12)""").write.parquet(str(tmp_path / "events.parquet"))
    rows = mq._event_features(Tables(spark, str(tmp_path))).select("event_id", "label", *mq.EVENT_FEATURES).collect()
    assert len(rows) == 12 and all(r.label == r.event_id * 1.5 and r.user_id_d == r.event_id % 5 and r.k == (0.0 if r.event_id % 3 == 0 else 4.0) for r in rows)


@pytest.mark.parametrize("name", ["v21_shift_right", "v08_batch_pad"])
def test_the_one_special_row_is_broadcast(spark, tmp_path, name):
    """A join of all texts with one row must not repeat the texts' side for each partition of the other."""
    spark.sql("SELECT id AS doc_id, concat('one two ', IF(id % 2 = 0, 'three', 'four')) AS text FROM range(64)").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = plans.QUERIES[name].build(spark, str(tmp_path))
        assert "CartesianProduct" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 64
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stacking_makes_its_features_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(i):
        made.add(1)
        return float(i % 7)

    df = spark.range(60).select(F.col("id").alias("key"), (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 3).cast("int").alias("fold"), feature("id").alias("x"))
    rows = md.stack(df, "fold", 3, {"p": lambda: md.classifier("lr")}, ["x"], "key", "label").collect()
    assert sorted(r.key for r in rows) == list(range(60)) and made.value == 60
