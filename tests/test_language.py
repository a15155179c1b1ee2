"""Trigram profiles and scores against the pattern and a plain loop."""

import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from wordlake.functions import text as tx
from wordlake.operators import language as lg


def test_trigrams_are_those_of_the_pattern(spark, monkeypatch):
    monkeypatch.setattr(lg, "CHARACTERS", 11)
    texts = ["", "ab", "abc abc", "été à la mer", None, "x𐐨y𐐨𐐨z", "𐐨", "日本語の文"]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "k int, t string, lang string")
    want = df.select(F.explode(tx.character_trigrams(tx.trigram_text("t"))).alias("tri")).groupBy("tri").count().collect()
    total = sum(r["count"] for r in want)
    got = {r.tri: r.logp for r in lg.train_profiles(df, "t", "lang").collect()}
    assert got == pytest.approx({r.tri: math.log(r["count"] + 1) - math.log(total + len(want)) for r in want})


def test_detection(spark, monkeypatch):
    """Scores of a plain loop; texts without a known trigram or without a key, and a key of two texts."""
    monkeypatch.setattr(lg, "CHARACTERS", 60)
    rnd = random.Random(5)
    train = [(" ".join(rnd.choice(words) for _ in range(6)), lang) for lang, words in {"de": ["und", "der", "nicht"], "en": ["and", "the", "not"]}.items() for _ in range(8)]
    texts = [(i, " ".join(rnd.choice(["und", "the", "not", "der", "qqq"]) for _ in range(5))) for i in range(20)] + [(20, "xxx yyy"), (21, None), (None, "the and"), (4, "the the the the and")]
    count = {lang: Counter(t[i : i + 3] for s, x in train if x == lang for t in [f" {s} "] for i in range(len(t) - 2)) for lang in ("de", "en")}
    want = {}
    for k in {k for k, _ in texts}:
        score = Counter()
        for key, s in texts:
            t = " " + re.sub("[^a-z]+", " ", s) + " " if s is not None and key == k and k is not None else ""
            for i in range(len(t) - 2):
                for lang, c in count.items():
                    if t[i : i + 3] in c:
                        score[lang] += math.log(c[t[i : i + 3]] + 1)
        want[k] = max(score, key=lambda x: (score[x], x)) if score else None
    profiles = lg.train_profiles(spark.createDataFrame(train, "text string, lang string"), "text", "lang")
    got = lg.detect(spark.createDataFrame(texts, "k long, text string"), "k", "text", profiles).collect()
    assert len(got) == len(texts) and {r.k: r.lang_detected for r in got} == want
