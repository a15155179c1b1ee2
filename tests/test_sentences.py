"""Sentences with learned abbreviations."""

from wordlake.operators import sentences as se

TEXT = ["We met Dr. Smith at the gate. He was late.", "Then Dr. Jones came! Was Dr. Smith ill?", "The U.S. team won. It was the best of the U.S. teams.",
        "In the U.S. the rules differ. The team left at 5 p.m. The rest of the team stayed until 7 p.m. and slept.", "J. Smith wrote to the team. the end",
        'She said "no." He left (at last). It is the end.', "Dr. Jones and Dr. Smith met the team of the U.S. at 3 p.m. in the rain."]
MORE = [f"The gate was late and the rain came at the end of day {i}. It was the rest of the team. He slept and she wrote." for i in range(40)]


def test_abbreviations_stay_whole(spark):
    docs = spark.createDataFrame([*enumerate(TEXT + MORE), (900, None), (901, " \n"), (902, "no end mark")], "k int, text string").repartition(3)
    found = {r["word"] for r in se.abbreviations(docs).collect()}
    assert {"dr", "u.s", "p.m"} <= found and not found & {"gate", "late", "end", "team", "wrote", "day", "slept"}
    got = {}
    for r in se.split_sentences(docs, "k").orderBy("k", "sent_id").collect():
        got.setdefault(r["k"], []).append(" ".join(r["tokens"]))
    assert got[0] == ["We met Dr. Smith at the gate.", "He was late."]
    assert got[1] == ["Then Dr. Jones came!", "Was Dr. Smith ill?"]
    assert got[2] == ["The U.S. team won.", "It was the best of the U.S. teams."]
    assert got[3] == ["In the U.S. the rules differ.", "The team left at 5 p.m.", "The rest of the team stayed until 7 p.m. and slept."]
    assert got[4] == ["J. Smith wrote to the team.", "the end"]
    assert got[5] == ['She said "no."', "He left (at last).", "It is the end."]
    assert got[6] == [TEXT[6]] and got[902] == ["no end mark"] and 900 not in got and 901 not in got


def test_sentence_words(spark):
    s = spark.createDataFrame([(1, 0, ["(The", "«End»", "--", "U.S."])], "k int, sent_id int, tokens array<string>")
    assert se.sentence_words(s, "k").first()["words"] == ["the", "end", "u.s"]


def test_patterns_meet_distinct_tokens(spark):
    """Equal tokens of a block are marked once, and counted as often as they stand."""
    docs = spark.createDataFrame([(i, "The team met Dr. Smith. He came.") for i in range(500)], "k int, text string").coalesce(1)
    blocks = se._blocks(docs, ["k"], "text")
    marked = se._marked(blocks)
    assert marked.count() == 7
    stats = {r["word"]: tuple(r)[1:] for r in se.word_statistics(blocks, marked).collect()}
    assert stats["team"] == (500, 0, 500, 0) and stats["smith"] == (500, 500, 0, 0) and stats["dr"] == (500, 500, 0, 500) and stats["he"] == (500, 0, 0, 0)


def test_equal_texts_and_texts_without_a_key(spark):
    docs = spark.createDataFrame([(1, "One came. Two went!"), (1, "One came. Two went!"), (None, "One came. Two went!"), (2, "?"), (3, None)], "k int, text string")
    got = sorted((r["k"] or 0, r["sent_id"], " ".join(r["tokens"])) for r in se.split_sentences(docs, "k").collect())
    assert got == [(0, 0, "One came. Two went!"), *[(1, 0, "One came.")] * 2, *[(1, 1, "Two went!")] * 2, (2, 0, "?")]
