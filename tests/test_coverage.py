"""Stemming, entities, Treebank-like tokens and piece labels on small known cases."""

import pytest
from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.functions import text as tx
from wordlake.operators import dataset as ds
from wordlake.operators import sequences as sq
from wordlake.operators import stemming as sm

# fixed values: words and stems of the published English Snowball vocabulary
STEMS = """caresses caress flies fli dies die mules mule denied deni died die agreed agre owned own humbled humbl sized size
meeting meet stating state itemization item sensational sensat traditional tradit reference refer colonizer colon plotted plot
consignment consign consistency consist knightly knight knots knot generously generous happily happili hopping hop hoping hope
cries cri ties tie gas gas gaps gap this this kiwis kiwi luxuriated luxuri communication communic knocked knock dying die
sky sky say say by by cry cri relational relat national nation running run skies sky proceed proceed herring herring
news news fairly fair beauty beauti adjustment adjust adoption adopt controlling control roll roll rate rate yes yes
analogies analog apologies apolog hopefulness hope electricity electr""".split()


def test_stems(spark):
    want = dict(zip(STEMS[::2], STEMS[1::2]))
    df = spark.createDataFrame([(w,) for w in want], "token string")
    got = {r.token: r.stem for r in sm.stem_words(df).collect()}
    assert got == want


def test_clean_and_stem(spark):
    df = spark.createDataFrame([(1, "a 1 24342 awd http://yahoo.com/test  dad good weather"), (2, "Running dogs, hopping!"), (3, ""), (4, None)], "k int, x string")
    got = {r.k: r.stems for r in sm.clean_and_stem(df, "k", "x").collect()}
    assert got == {1: "awd dad good weather", 2: "run dog hop", 3: "", 4: ""}


def test_entities(spark):
    df = spark.createDataFrame([("a&#8217;b &copy; &#x1F600;&amp;lt; &#0; &#39;q&#39; &none;",), ("plain",), (None,)], "x string")
    got = [r[0] for r in df.select(tx.unescape_entities("x")).collect()]
    assert got == ["a’b © \U0001F600&lt; � 'q' &none;", "plain", None]


@pytest.mark.parametrize("text, tokens", [("time-out", ["time-out"]), ("the U.S. won...", ["the", "U.S.", "won", "..."]), ("a -- b", ["a", "--", "b"]),
                                          ("shouldn't it's 1,000.5", ["should", "n't", "it", "'s", "1,000.5"]), ("", [])])
def test_penn_tokens(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "x string").select(tx.penn_tokens("x")).first()[0] == tokens


def test_piece_labels(spark):
    df = spark.createDataFrame([(["abc", "d", "ef"], [0, 0, 0, 1, 0, 1]), ([], [])], "p array<string>, m array<int>")
    assert [r[0] for r in df.select(ar.piece_labels("p", "m")).collect()] == [[0, 1, 1], []]


def test_language_fallback_takes_the_first_text_that_yields_one(spark):
    from wordlake.operators import language as lg

    english, german = "the house and the garden and the other thing", "das haus und der garten und die andere sache"
    train = spark.createDataFrame([("en", english), ("de", german)], "lang string, text string")
    rows = [(1, english, german), (2, None, german), (3, "", german), (4, "漢字", german), (5, None, None), (6, "", ""), (7, german, english)]
    df = spark.createDataFrame(rows, "id long, one string, two string")
    profiles = lg.train_profiles(train, "text", "lang")
    got = {r.id: r.lang_detected for r in lg.detect_with_fallback(df, "id", ["one", "two"], profiles).collect()}
    assert got == {1: "en", 2: "de", 3: "de", 4: "de", 5: None, 6: None, 7: "de"}


def test_prefix_of_few_and_many_rows(spark, monkeypatch):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 500).alias("k"))
    few = [r.k for r in ds.prefix_rows(df, [F.desc("k")], 20).collect()]
    monkeypatch.setattr(ds, "FEW_ROWS", 10)
    many = [r.k for r in ds.prefix_rows(df, [F.desc("k")], 20).collect()]
    assert few == sorted(many, reverse=True) == list(range(499, 479, -1))


def test_sentences_without_words_keep_their_place(spark):
    df = spark.createDataFrame([(1, [["a", "b"], [], ["c"]])], "id long, s array<array<string>>")
    got = {(r.sent_id, r.offset, r.sentence, r.context) for r in sq.sentence_word_pairs(df, "s", 1, "id").collect()}
    assert got == {(0, -1, "a b", "--"), (0, 1, "a b", "c"), (1, -1, "", "b"), (1, 1, "", "c"), (2, -1, "c", "b"), (2, 1, "c", "--")}
