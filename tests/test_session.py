"""The shared folder: never a machine-local one on a cluster."""

from types import SimpleNamespace

import pytest

from wordlake.session import checkpoint_dir


class _Conf:
    def get(self, key, default=None):
        return default


def test_unset_folder_is_an_error_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: _Conf(), getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(conf=_Conf(), sparkContext=context))


def test_token_rows_with_quotes(spark, tmp_path):
    from wordlake.sources.files import read_token_rows
    (tmp_path / "t.csv").write_text('1,hello,",",world,,\n2,"say ""hi""",a,,b\n3,,\n4\n')
    got = {r.id: r.tokens for r in read_token_rows(spark, str(tmp_path)).collect()}
    assert got == {1: ["hello", ",", "world"], 2: ['say "hi"', "a", "", "b"], 3: [], 4: []}


def test_exponential_fit_recovers_parameters(spark):
    import math

    from wordlake.operators.stats import fit_exponential_decay
    rows = [(float(x), 3.0 * math.exp(-0.4 * x)) for x in range(12)]
    got = fit_exponential_decay(spark.createDataFrame(rows, "x double, y double"), "x", "y")
    assert got["a"] == pytest.approx(3.0) and got["b"] == pytest.approx(0.4)
