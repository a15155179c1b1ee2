"""English Snowball (Porter2) stemming as a vocabulary job (T9, T4): each distinct word is stemmed once by column
expressions in the JVM, and the stems are joined back to the tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordlake.functions import text as tx

# fixed values: the endings, replacements and exceptions of the published English Snowball algorithm
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
          "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
          "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
          "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
          "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous",
          "ive", "ize", "ion"]
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
           "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky",
           "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT_AFTER_1A = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
LONG_PREFIXES = "gener|commun|arsen"

REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT_END = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def _found(df: DataFrame, endings) -> DataFrame:
    """``s``, the longest of the endings of ``w`` ('' if none), and ``b``, what stands before it."""
    df = df.withColumn("s", F.regexp_extract("w", f"({'|'.join(endings)})$", 1))
    return df.withColumn("b", F.expr("left(w, length(w) - length(s))"))


def stem_words(words: DataFrame, col: str = "token", out: str = "stem") -> DataFrame:
    """``words`` with the stem of the lower-case word in ``col``; words of one or two letters, and null, stay."""
    inside_1, inside_2 = F.length("b") >= F.col("r1"), F.length("b") >= F.col("r2")
    df = words.withColumn("w", F.regexp_replace(col, "^y|(?<=[aeiou])y", "Y"))
    df = df.withColumn("e", F.regexp_extract("w", f"^({LONG_PREFIXES}|{REGION})", 1))
    df = df.withColumn("r1", F.when(F.col("e") == "", F.length("w")).otherwise(F.length("e")))
    df = df.withColumn("e", F.regexp_extract(F.expr("substr(w, r1 + 1)"), f"^{REGION}", 0))
    df = df.withColumn("r2", F.when(F.col("e") == "", F.length("w")).otherwise(F.col("r1") + F.length("e")))
    # 1a: plurals
    df = df.withColumn("w", F.when(F.col("w").endswith("sses"), F.expr("left(w, length(w) - 2)"))
                       .when(F.col("w").rlike("..(ied|ies)$"), F.expr("left(w, length(w) - 2)"))
                       .when(F.col("w").rlike("(ied|ies)$"), F.expr("left(w, length(w) - 1)"))
                       .when(F.col("w").rlike("(us|ss)$"), F.col("w"))
                       .when(F.col("w").rlike("[aeiouy].+s$"), F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")))
    df = df.withColumn("after_1a", F.col("w"))
    # 1b: past and progressive forms
    df = _found(df, ["eedly", "eed", "ingly", "edly", "ing", "ed"])
    ee = F.col("s").isin("eed", "eedly")
    df = df.withColumn("w", F.when(ee & inside_1, F.concat("b", F.lit("ee")))
                       .when(ee | (F.col("s") == "") | ~F.col("b").rlike("[aeiouy]"), F.col("w"))
                       .when(F.col("b").rlike("(at|bl|iz)$"), F.concat("b", F.lit("e")))
                       .when(F.col("b").rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.expr("left(b, length(b) - 1)"))
                       .when(F.col("b").rlike(SHORT_END) & (F.col("r1") >= F.length("b")), F.concat("b", F.lit("e"))).otherwise(F.col("b")))
    # 1c: a last y after a consonant
    df = df.withColumn("w", F.regexp_replace("w", "(?<=.[^aeiouy])[yY]$", "i"))
    # 2, 3: longer endings to shorter ones
    df = _found(df, STEP_2)
    fits = F.when(F.col("s") == "ogi", F.col("b").endswith("l")).when(F.col("s") == "li", F.col("b").rlike("[cdeghkmnrt]$")).otherwise(True)
    df = df.withColumn("w", F.when((F.col("s") != "") & inside_1 & fits, F.concat("b", _lookup(STEP_2)[F.col("s")])).otherwise(F.col("w")))
    df = _found(df, STEP_3)
    fits = F.when(F.col("s") == "ative", inside_2).otherwise(inside_1)
    df = df.withColumn("w", F.when((F.col("s") != "") & fits, F.concat("b", _lookup(STEP_3)[F.col("s")])).otherwise(F.col("w")))
    # 4, 5: endings that go
    df = _found(df, STEP_4)
    fits = F.when(F.col("s") == "ion", F.col("b").rlike("[st]$")).otherwise(True)
    df = df.withColumn("w", F.when((F.col("s") != "") & inside_2 & fits, F.col("b")).otherwise(F.col("w")))
    df = _found(df, ["e", "l"])
    gone = F.when(F.col("s") == "e", inside_2 | (inside_1 & ~F.col("b").rlike(SHORT_END))).otherwise(inside_2 & F.col("b").endswith("l"))
    df = df.withColumn("w", F.lower(F.when((F.col("s") != "") & gone, F.col("b")).otherwise(F.col("w"))))
    stem = F.when(F.length(col) <= 2, F.col(col)).when(F.col(col).isin(list(SPECIAL)), _lookup(SPECIAL)[F.col(col)]) \
        .when(F.col("after_1a").isin(KEPT_AFTER_1A), F.col("after_1a")).otherwise(F.col("w"))
    return df.select(*words.columns, stem.alias(out))


def clean_and_stem(df: DataFrame, key: str, text_col: str, out: str = "stems") -> DataFrame:
    """T4: links, non-letters and stop words removed, words stemmed and joined by spaces; '' when nothing is left."""
    tokens = df.select(F.col(key), F.posexplode(tx.clean_words(text_col)).alias("pos", "token"))
    stems = stem_words(tokens.select("token").distinct())
    joined = tokens.join(stems, "token").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "stem"))).alias("t"))
    joined = joined.select(key, F.array_join("t.stem", " ").alias(out))
    return df.select(key).join(joined, key, "left").select(key, F.coalesce(out, F.lit("")).alias(out))
