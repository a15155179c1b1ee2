"""Operators 5 and 10: DuckDB twins, and cases worked by hand."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.oracle_compare import _rows, duck
from wordlake.llm.mixing import apply_mix, leaf_quotas, mix_sources
from wordlake.llm.queries import LLM_QUERIES, LLM_SQL
from wordlake.llm.revisits import canonical_url, resolve_revisits


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_matches_duckdb(spark, name):
    df = LLM_QUERIES[name](spark, SF01)
    cur = duck(SF01).execute(LLM_SQL[name])
    names = [d[0] for d in cur.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, cur.fetchall())


def fill(budget, children):
    """Water filling by rounds: (cap, weight) -> budgets."""
    out, left = [0.0] * len(children), budget
    for _ in range(200):
        open_ = [i for i, (cap, _) in enumerate(children) if out[i] < cap - 1e-9]
        if left < 1e-9 or not open_:
            break
        total = sum(children[i][1] for i in open_)
        for i in open_:
            part = min(children[i][0] - out[i], left * children[i][1] / total)
            out[i] += part
        left = budget - sum(out)
    return out


def test_quotas_fill_siblings_first(spark):
    leaves = [("web", "en", "s0", 100), ("web", "en", "s1", 1000), ("web", "de", "s2", 50), ("print", "en", "s3", 5000), ("print", "fr", "s4", 0)]
    w = {"web": 3.0, "web/en": 2.0, "web/en/s0": 5.0}
    df = leaf_quotas(spark.createDataFrame(leaves, "domain string, lang string, source string, available long"), w, 0.9, 2)
    got = {r.source: (r.quota, r.full_epochs, r.rest) for r in df.collect()}
    web, prints = fill(0.9 * 6150, [(2300, 3.0), (10000, 1.0)])
    en, de = fill(web, [(2200, 2.0), (100, 1.0)])
    s0, s1 = fill(en, [(200, 5.0), (2000, 1.0)])
    for k, want in {"s0": s0, "s1": s1, "s2": de, "s3": prints, "s4": 0}.items():
        assert abs(got[k][0] - want) <= 1, (k, got, want)
    assert got["s0"] == (200, 2, 0) and got["s4"] == (0, 0, 0)


def test_mix_odd_rows(odd_docs, no_docs):
    assert mix_sources(no_docs, {}).count() == 0 and apply_mix(no_docs, {}).columns == no_docs.columns
    rows = mix_sources(odd_docs, {"web": 2.0}, budget_share=1.5, max_epochs=3).collect()
    assert len(rows) == odd_docs.count()
    total = sum(r.n_tokens for r in rows)
    taken = sum(r.total_tokens for r in rows)
    leaves = {(r.domain, r.lang, r.source) for r in rows}
    assert abs(taken - 1.5 * total) <= len(leaves)
    for leaf in leaves:
        own = [r for r in rows if (r.domain, r.lang, r.source) == leaf]
        assert len({r.full_epochs for r in own}) == 1 and sum(0 < r.prefix_tokens < r.n_tokens for r in own) <= 1


def test_apply_mix_cuts_words(odd_docs):
    mixed = apply_mix(odd_docs, {"web": 2.0}, budget_share=1.5, max_epochs=3)
    assert mixed.columns == odd_docs.columns and mixed.schema["n_chars"].dataType == odd_docs.schema["n_chars"].dataType
    want = mix_sources(odd_docs, {"web": 2.0}, budget_share=1.5, max_epochs=3).agg(F.sum("total_tokens")).first()[0]
    got = mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert got == want
    for r in mixed.where("text is not null").collect():
        src = [x.text for x in odd_docs.collect() if x.doc_id == r.doc_id]
        assert any(t is not None and t.startswith(r.text) for t in src)


def test_urls(spark):
    cases = {"HTTP://Ex.org:80/a/?b=2&a=1&utm_source=x#f": "ex.org/a?a=1&b=2", "https://ex.org": "ex.org", "ex.org/A//": "ex.org/A",
             "https://ex.org?ref=1": "ex.org", "": "", "https://ex.org:8080/x?": "ex.org:8080/x"}
    df = spark.createDataFrame([*cases.items(), (None, None)], "u string, want string")
    for r in df.select("want", canonical_url(F.col("u")).alias("got")).collect():
        assert r.got == r.want


REC = "record_id long, kind string, url string, ts long, etag string, last_modified string, digest string, headers map<string,string>, outcome string"


def test_revisits(spark):
    h = {"content-type": "text/html", "date": "1", "x": "kept"}
    rows = [(1, "response", "http://a/", 10, "e1", "d1", "p1", h, "clash"), (2, "response", "https://A", 20, "e2", "d2", "p2", h, None),
            (3, "revisit", "a#x", 30, 'W/"no', None, None, {"date": "3"}, None), (4, "revisit", "a", 15, "W/e1", None, "p1", {"date": "2", "content-type": "no"}, None),
            (5, "revisit", "a", 5, "e1", None, None, None, None), (6, "revisit", "a", 30, None, "d2", None, None, None), (7, "revisit", "a", 30, None, "d9", None, None, None),
            (8, "revisit", None, 30, "e2", None, None, None, None), (9, "revisit", "a", None, "e2", None, None, None, None), (10, "request", "a", 29, None, None, None, None, None),
            (11, "response", "b", 40, None, None, None, None, None), (12, "revisit", "b", 40, "z", "z", "z", {"date": "4"}, None),
            (13, "revisit", "a", 20, "e2", None, "other", None, None)]
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, REC)).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {
        3: ("changed", None), 4: ("resolved", 1), 5: ("no_response", None), 6: ("resolved", 2), 7: ("changed", None), 8: ("no_response", None),
        9: ("no_response", None), 12: ("resolved", 11), 13: ("changed", None)}
    assert got[4].headers == {"content-type": "text/html", "date": "2", "x": "kept"} and got[4].response_digest == "p1"
    assert got[12].headers == {"date": "4"} and got[5].headers is None
    assert resolve_revisits(spark.createDataFrame([], REC)).count() == 0


def test_revisits_by_brute_force(spark):
    """One hot URL over all buckets, ties in time."""
    import random
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["response", "revisit"]), "hot" if rnd.random() < 0.6 else f"u{rnd.randint(0, 9)}", rnd.randint(0, 3000), None, None, None, None, None) for i in range(3000)]
    got = {r.record_id: r.response_id for r in resolve_revisits(spark.createDataFrame(rows, REC)).collect()}
    for r in rows:
        if r[1] == "revisit":
            before = [(x[3], x[0]) for x in rows if x[1] == "response" and x[2] == r[2] and (x[3], x[0]) < (r[3], r[0])]
            assert got[r[0]] == (max(before)[1] if before else None)
