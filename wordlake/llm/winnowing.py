"""Operator 11, benchmark decontamination by winnowing.

Of the hashes of all k-word grams, the least of every window of ``span - k + 1`` consecutive ones is kept (the leftmost of
equal ones). A window covers ``span`` words, and what it keeps depends on these words alone, so a stretch of ``span`` words
that a document shares with a benchmark item always leaves the same gram of it on both sides. Grams are joined, and each
hit is extended word by word to both sides; a stretch of at least ``span`` words is contaminated.

Items of fewer words are one stretch of their own length, so there is a class of grams per length (at most ``span``, and
only those that occur); the length goes into the hash.

All of it is DataFrame expressions. First the least hashes of the documents, one row each, are held against those of the
benchmark, which leaves the texts that have a gram in common; only these get positions and neighbouring words, to be
extended. The benchmark's grams, the texts found and the hits are written and counted; they are broadcast while their
rows, of fixed width, stay below ``BROADCAST_BYTES``, else joined by shuffle. Texts are told apart by 128 bits of hash and
their length, so equal texts are extended once, and words and grams by 64 bits. Long texts are cut into pieces of
``PIECE`` words that share ``span - 1`` words with the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordlake.session import cut_lineage

OTHER, INNER = r"\x00-\x2F\x3A-\x60\x7B-\x7F", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = 10
PIECE = 20_000
LONG_TEXT = 1 << 20
BROADCAST_BYTES = 32 << 20
KEY = ("text_a", "text_b", "text_size")


def gram_words(span: int) -> int:
    """Words of a gram in stretches of ``span`` words: six tenths, so that few other texts share one."""
    return -(-span * 6 // 10)


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _words(low: Column) -> Column:
    """The words of a text in lower case; a split is several times faster than extracting all matches."""
    return F.array_remove(F.split(low, f"[{OTHER}]+"), "")


def _keyed(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with a text's key and the text in lower case."""
    low = rows.withColumn("low", _lowered(F.col(text_col)))
    return low.withColumns({"text_a": F.xxhash64("low"), "text_b": F.xxhash64(F.lit(11), "low"), "text_size": F.octet_length("low").cast("long")})


def _word_hashes(rows: DataFrame, keep: tuple[str, ...], span: int) -> DataFrame:
    """(*keep, at, h): the word hashes of each piece of ``low``; ``at`` is the number of words before the piece."""
    some = f"(?:[{OTHER}]*+{INNER}++)"
    size = max(PIECE, span)  # so that the next piece alone holds the words to be shared
    cut = F.regexp_extract_all(F.col("low"), F.lit(f"{some}{{1,{size}}}+"), F.lit(0))
    pieces = rows.withColumn("pieces", F.when(F.octet_length("low") > LONG_TEXT, cut).otherwise(F.array("low")))
    heads = F.transform(F.slice("pieces", 2, 1 << 30), lambda p: F.regexp_extract(p, f"^{some}{{1,{max(1, span - 1)}}}+", 0))
    pieces = pieces.select(*keep, F.posexplode(F.arrays_zip(F.col("pieces").alias("piece"), heads.alias("head"))).alias("k", "x"))
    text = F.when(F.col("x.head").isNull(), F.col("x.piece")).otherwise(F.concat_ws(" ", "x.piece", "x.head"))
    return pieces.select(*keep, (F.col("k").cast("long") * size).alias("at"), _words(text).alias("w")).select(
        *keep, "at", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))


def _grams(hashed: DataFrame, keep: tuple[str, ...], span: int) -> DataFrame:
    """(*keep, h, g): with the hashes of all grams of the class ``span``, for rows of at least ``span`` words."""
    k = gram_words(span)
    gram = lambda i: F.xxhash64(F.lit(span), *(F.get("h", i + j) for j in range(k)))
    return hashed.where(F.size("h") >= span).withColumn("g", F.transform(F.sequence(F.lit(0), F.size("h") - k), gram))


def _windows(span: int) -> Column:
    return F.sequence(F.lit(1), F.size("h") - span + 1)


def fingerprints(hashed: DataFrame, keep: tuple[str, ...], span: int) -> DataFrame:
    """(*keep, gram): the distinct least hashes of a row's windows."""
    width = span - gram_words(span) + 1
    least = F.array_distinct(F.transform(_windows(span), lambda s: F.array_min(F.slice("g", s, width))))
    return _grams(hashed, keep, span).select(*keep, F.explode(least).alias("gram"))


def placed_fingerprints(hashed: DataFrame, keep: tuple[str, ...], span: int, most: int) -> DataFrame:
    """(*keep, span, gram, first, left, right): each kept gram, its first word's number, and the words beside it, nearest
    first: ``most`` hashes each, null beyond the row's ends."""
    k = gram_words(span)
    width = span - k + 1
    place = lambda s: s + F.array_position(F.slice("g", s, width), F.array_min(F.slice("g", s, width))).cast("int") - 2
    places = F.array_distinct(F.transform(_windows(span), place))
    none = F.lit(None).cast("long")
    far = span - k  # words further away than this stand in no window with the gram

    def mark(i: Column) -> Column:
        left = [F.when(i >= j, F.get("h", F.greatest(i - j, F.lit(0)))) if j <= far else none for j in range(1, most + 1)]
        right = [F.get("h", i + (k + j)) if j < far else none for j in range(most)]
        return F.struct(F.get("g", i).alias("gram"), i.alias("first"), F.array(*left).alias("left"), F.array(*right).alias("right"))

    marked = _grams(hashed, keep, span).withColumn("places", places).select(*keep, "at", F.explode(F.transform("places", mark)).alias("m"))
    return marked.select(*keep, F.lit(span).alias("span"), "m.gram", (F.col("at") + F.col("m.first")).alias("first"), "m.left", "m.right")


def _equal_words(a: str, b: str, most: int) -> Column:
    """How many of the first words of two lists are equal."""
    n = F.lit(0)
    for j in reversed(range(most)):
        n = F.when(F.get(a, F.lit(j)) == F.get(b, F.lit(j)), n + 1).otherwise(0)
    return n


def _small(rows: DataFrame, width: int) -> DataFrame:
    """A written table of rows of ``width`` bytes, to be broadcast if its counted size allows it."""
    return F.broadcast(rows) if rows.count() * width <= BROADCAST_BYTES else rows


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words in a shared stretch), items (sorted ids as text).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. A stretch is ``span`` consecutive words of an
    item, or all words of an item that has fewer. A null or empty text has no words and no hits; an item without words
    has no stretch; items of one id count once, and items without an id hit words but are not named. Equal rows and
    null or repeated document ids stay as they are; extra columns are not read. No items: nothing is hit.
    """
    # Prefixed names: input columns can't clash with the ones made here.
    items = _keyed(benchmark.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).alias("body")), "body")
    texts = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")), "body")
    items = cut_lineage(items.select("item", "low", F.size(_words(F.col("low"))).alias("n")).where("n > 0"))
    spans = sorted(r[0] for r in items.select(F.least("n", F.lit(span)).alias("span")).distinct().collect())  # at most ``span`` numbers
    counted = texts.select("doc_id", *KEY, F.size(_words(F.col("low"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if not spans:
        return counted.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    most = max(s - gram_words(s) for s in spans)
    marked = _union([placed_fingerprints(_word_hashes(items.where(F.least("n", F.lit(span)) == s), ("item",), s), ("item",), s, most) for s in spans])
    sides = F.array(*(F.coalesce(F.get(c, F.lit(j)), F.lit(0).cast("long")) for c in ("left", "right") for j in range(most)))
    owners = cut_lineage(marked.select("gram", "span", "left", "right", F.xxhash64("gram", sides).alias("place"), "item").distinct())
    places = cut_lineage(owners.select("gram", "span", "left", "right", "place").distinct())
    named = owners.select("place", "item").where("item is not null").distinct()
    known = _small(cut_lineage(places.select("gram").distinct()), 32)
    common = [fingerprints(_word_hashes(texts, KEY, s), KEY, s) for s in spans]
    found = cut_lineage(_union(common).join(known, "gram", "left_semi").select(*KEY).distinct())
    suspects = texts.select(*KEY, "low").join(_small(found, 56), list(KEY), "left_semi")
    marks = _union([placed_fingerprints(_word_hashes(suspects, KEY, s), KEY, s, most) for s in spans])
    met = marks.alias("d").join(_small(places, 64 + 32 * max(1, most)).alias("b"), ["gram", "span"])
    grams = F.element_at(F.create_map(*(F.lit(x) for s in spans for x in (s, gram_words(s)))), F.col("span"))
    met = met.select(*KEY, "first", "span", "place", grams.alias("k"), _equal_words("d.left", "b.left", most).alias("before"), _equal_words("d.right", "b.right", most).alias("after"))
    hits = cut_lineage(met.where("before + k + after >= span").select(
        *KEY, "place", (F.col("first") - F.col("before")).alias("start"), (F.col("first") + F.col("k") + F.col("after") - 1).alias("end")).distinct())
    words = hits.select(*KEY, "start", "end").distinct().select(*KEY, F.explode(F.sequence("start", "end")).alias("word")).distinct()
    words = words.groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    lists = hits.select(*KEY, "place").distinct().join(named, "place").select(*KEY, "item").distinct()
    lists = lists.groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = cut_lineage(words.join(lists, list(KEY), "left"))
    return counted.join(result, list(KEY), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))
