"""Archive source and table function: pieces smaller than a row, suffixes, members, schemas."""

import gzip
import zipfile

import pytest

from wordlake.functions import table_functions as tf
from wordlake.sources import archives as ac


def test_lines_and_words_over_piece_borders(spark, tmp_path, monkeypatch):
    text = "one two\n\nthrée  four\tfive\n" + "x" * 50 + " last"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("first.txt", text)
        z.writestr("second.txt", "more words")
    (tmp_path / "b.gzip").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.txt").write_text(text)
    (tmp_path / "_d.txt").write_text("hidden")
    for piece, rows in ((1 << 20, 8192), (3, 2)):
        monkeypatch.setattr(ac, "PIECE", piece)
        monkeypatch.setattr(ac, "ROWS", rows)
        for name in ("a.zip", "b.gzip", "c.txt"):
            file = ac.File(str(tmp_path / name), 1)
            for unit, want in (("line", text.split("\n")), ("word", text.split())):
                batches = list(ac.ArchiveReader({"path": str(tmp_path), "unit": unit}).read(file))
                assert [x for b in batches for x in b.column("value").to_pylist()] == want
                assert [x for b in batches for x in b.column("pos").to_pylist()] == list(range(len(want)))
    got = ac.read_archive(spark, f"file://{tmp_path}", ".zip", unit="word", members="all").orderBy("member", "pos").collect()
    assert [r["value"] for r in got] == [*text.split(), "more", "words"] and {r["length"] for r in got} == {(tmp_path / "a.zip").stat().st_size}
    assert ac.read_archive(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    with pytest.raises(Exception):
        ac.read_archive(spark, str(tmp_path), unit="page").count()


@pytest.mark.parametrize("suffix", [".zip", ".gzip"])
def test_shards_come_back(spark, tmp_path, suffix):
    rows = spark.createDataFrame([(f"line {i} é",) for i in range(500)] + [(None,)], "v string")
    assert ac.write_shards(rows, "v", f"file://{tmp_path}/out", suffix, 3) == 500
    back = ac.read_archive(spark, f"file://{tmp_path}/out", suffix)
    assert sorted(r["value"] for r in back.collect()) == sorted(f"line {i} é" for i in range(500))
    assert back.select("path").distinct().count() == 3


def test_table_function(spark):
    df = spark.createDataFrame([("a", 3, 30), ("a", 1, 10), ("b", 1, 5), ("a", 2, None)], "k string, at int, v int")
    out = tf.windows(df, "k", "at", "v", 2)
    assert out.dtypes == [("k", "string"), ("start", "int"), ("w1", "int"), ("w2", "int")]
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 10, None), ("a", 1, None, 30)]
    tf.register(spark)
    df.createOrReplaceTempView("some_rows")
    assert spark.sql("select * from windows(table(some_rows), 'k', 'at', 'v', 1)").count() == 4
    with pytest.raises(Exception):
        tf.windows(df, "k", "at", "none", 2).collect()
