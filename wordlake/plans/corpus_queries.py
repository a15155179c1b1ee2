"""Registered queries whose windows run over a whole table as one stream, across rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordlake.functions import text as tx
from wordlake.operators import blocked_pairs as bp
from wordlake.operators import cooccur as co
from wordlake.operators import corpus_windows as cw
from wordlake.operators import sentences as se
from wordlake.plans import sqlfrag as q
from wordlake.plans.registry import Tables, query


def _conversation_tokens(t):
    """(conv_id, turn, pos, token) rows of all turns."""
    words = t.conversations.select("conv_id", "turn", tx.letters_only_words("text").alias("w"))
    return words.select("conv_id", "turn", F.posexplode("w").alias("pos", "token"))


def _conversation_segments(t):
    return cw.pack(_conversation_tokens(t), ["conv_id", "turn", "pos"])


def _document_segments(t):
    """Documents as segments of one stream, in doc_id order."""
    return cw.segments_of(t.documents.select("doc_id", tx.letters_only_words("text").alias("w")), "w", ["doc_id"])


def _stream_sql(src: str, keys: str) -> str:
    """(k, i, keys, token): all words of a table in key order, k from 1."""
    return f"""(SELECT row_number() OVER (ORDER BY {keys}, i) AS k, {keys}, i - 1 AS i, token FROM (
  SELECT {keys}, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM {src}))"""


_CONV = _stream_sql(f"(SELECT conv_id, turn, {q.letters_only_words('text')} AS w FROM conversations)", "conv_id, turn")
_DOCS = _stream_sql(f"(SELECT doc_id, {q.letters_only_words('text')} AS w FROM documents)", "doc_id")


def _pairs(stream: str, window: int) -> str:
    """Pairs of the tokens p (col) and q = p + d (row)."""
    return f"""(WITH s AS {stream}, n AS (SELECT count(*) AS n FROM s), d AS (SELECT unnest(generate_series(1, {window})) AS d)
  SELECT b.token AS row_word, a.token AS col_word, a.k AS p, d.d, n.n FROM s a CROSS JOIN d CROSS JOIN n JOIN s b ON b.k = a.k + d.d)"""


def _both_ways(pairs: str, weight: str, where: str = "true") -> str:
    return f"""(SELECT row_word, col_word, sum(w) AS weight FROM (WITH x AS (SELECT row_word, col_word, {weight} AS w FROM {pairs} WHERE {where})
  SELECT row_word, col_word, w FROM x UNION ALL SELECT col_word, row_word, w FROM x) WHERE w > 0 GROUP BY 1, 2)"""


_C4 = "CAST(greatest(least(p - 1 + 5, n - 1) - (p - 1 + d), 0) AS DOUBLE)"


@query("c01_corpus", f"""SELECT row_word, col_word, CAST(count(*) AS DOUBLE) AS weight FROM {_pairs(_CONV, 2)}
WHERE row_word <> col_word GROUP BY 1, 2""")
def c01_corpus(spark, d):
    """C1 + J9 over all turns as one stream of (conv_id, turn, pos, token) rows, window 2, equal words skipped."""
    return cw.matrix(cw.context_pairs(_conversation_segments(Tables(spark, d)), 2), skip_equal=True, symmetric=False)


@query("c02_corpus", f"SELECT * FROM {_both_ways(_pairs(_DOCS, 5), '1.0::DOUBLE', 'row_word <> col_word')}")
def c02_corpus(spark, d):
    """C2 over all documents as one stream, window 5 across documents, equal words skipped."""
    words = Tables(spark, d).documents.select("doc_id", tx.letters_only_words("text").alias("w"))
    return bp.stream_two_sided(words, "w", ["doc_id"], 5)


@query("c03_corpus", f"SELECT * FROM {_both_ways(_pairs(_CONV, 2), '1.0::DOUBLE')}")
def c03_corpus(spark, d):
    """C3 over all turns as one stream, window 2, equal words kept."""
    return cw.matrix(cw.context_pairs(_conversation_segments(Tables(spark, d)), 2), skip_equal=False, symmetric=True)


@query("c04_corpus", f"SELECT * FROM {_both_ways(_pairs(_DOCS, 4), _C4)}")
def c04_corpus(spark, d):
    """C4 over all documents as one stream: sliding-window pair counts, window 5 across documents."""
    return cw.matrix(cw.sliding_pairs(_document_segments(Tables(spark, d)), 5, unordered=True), skip_equal=False, symmetric=True)


@query("c05_corpus", f"""SELECT row_word, col_word, round(weight / sum(weight) OVER (), 9) AS weight
FROM {_both_ways(_pairs(_CONV, 4), _C4)}""")
def c05_corpus(spark, d):
    """C5 over all turns as one stream: window-pair counts divided by their total."""
    m = co.normalize_total(cw.matrix(cw.sliding_pairs(_conversation_segments(Tables(spark, d)), 5), skip_equal=False, symmetric=True))
    return m.select("row_word", "col_word", F.round("weight", 9).alias("weight"))


@query("w09_corpus", f"""WITH s AS {_CONV}, o AS (SELECT unnest([-2, -1, 1, 2]) AS o)
SELECT s.conv_id, s.turn, s.i AS pos, o.o AS offset, s.token AS word, coalesce(c.token, '--') AS context
FROM s CROSS JOIN o LEFT JOIN s c ON c.k = s.k + o.o""")
def w09_corpus(spark, d):
    """W9 over all turns as one stream: two words before and after, across turns; '--' only at the table's ends."""
    t = Tables(spark, d)
    words = t.conversations.select("conv_id", "turn", tx.letters_only_words("text").alias("w"))
    p = cw.skipgram_rows(cw.segments_of(words, "w", ["conv_id", "turn"]), 2)
    return p.select("at.conv_id", "at.turn", F.col("i").cast("long").alias("pos"), "offset", "word", "context")


@query("w09_corpus_rows", f"""WITH s AS {_CONV}, o AS (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS o)
SELECT s.conv_id, s.turn, s.i AS pos, o.o AS offset, s.token AS word, coalesce(c.token, '--') AS context
FROM s CROSS JOIN o LEFT JOIN s c ON c.k = s.k + o.o AND c.conv_id = s.conv_id""")
def w09_corpus_rows(spark, d):
    """W9 on (stream, pos, token) rows, one stream a conversation: three words before and after, across its turns."""
    segments = cw.pack(_conversation_tokens(Tables(spark, d)), ["conv_id", "turn", "pos"], stream_col="conv_id")
    return cw.skipgram_rows(segments, 3, keyed=True).where(F.col("stream").isNotNull()).select(
        "key.conv_id", "key.turn", F.col("key.pos").cast("long").alias("pos"), "offset", "word", "context")


_OPEN, _CLOSE = r"""["''(\[]""", r"""["'')\]]"""


def _core_sql(x: str) -> str:
    inner = f"""regexp_replace({x}, '^{_OPEN}+|["'')\\],;:!?]+$', '', 'g')"""
    return f"lower(regexp_replace({inner}, '\\.$', ''))"


def _ends_sql(x: str, marks: str) -> str:
    return f"coalesce(regexp_matches({x}, '[{marks}]{_CLOSE}*$'), false)"


_UPPER = f"regexp_matches({{}}, '^{_OPEN}*\\p{{{{Lu}}}}')"
_SENTENCE_SQL = f"""
d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents),
pl AS MATERIALIZED (SELECT doc_id, i - 1 AS i, w[i] AS cur, w[i + 1] AS nxt, CASE WHEN i > 1 THEN w[i - 1] END AS prv
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
st AS (SELECT {_core_sql('cur')} AS word, count(*) AS n, count(*) FILTER (WHERE {_ends_sql('cur', '.')}) AS a,
  count(*) FILTER (WHERE regexp_matches(cur, '^{_OPEN}*\\p{{Ll}}')) AS n_lower,
  count(*) FILTER (WHERE {_UPPER.format('cur')} AND prv IS NOT NULL AND NOT {_ends_sql('prv', '.!?')}) AS n_up FROM pl GROUP BY 1),
tot AS (SELECT sum(n)::DOUBLE AS an, sum(a)::DOUBLE AS aa FROM st),
sc AS MATERIALIZED (SELECT word, n_lower > n_up AS common, CASE WHEN l > 0 AND regexp_matches(word, '\\p{{L}}') AND a > 0 AND aa / an < 0.99 THEN
    -2 * (a * ln(aa / an) + CASE WHEN n > a THEN (n - a) * ln(1 - aa / an) ELSE 0 END - (a * ln(0.99) + (n - a) * ln(1 - 0.99)))
    * exp(-l) * (length(word) - l + 1) * pow(l, -(n - a)) ELSE 0 END AS score
  FROM (SELECT *, length(replace(word, '.', ''))::DOUBLE AS l FROM st), tot),
stops AS (SELECT doc_id, i FROM (SELECT doc_id, i, {_core_sql('cur')} AS word, {_core_sql('nxt')} AS next, coalesce({_UPPER.format('nxt')}, false) AS upper
    FROM pl WHERE {_ends_sql('cur', '.')} AND nxt IS NOT NULL) h JOIN sc a ON a.word = h.word JOIN sc b ON b.word = h.next
  WHERE NOT (a.score >= 0.3 OR regexp_matches(h.word, '^\\p{{L}}$')) OR (h.upper AND b.common)
  UNION SELECT doc_id, i FROM pl WHERE {_ends_sql('cur', '!?')}),
tk AS (SELECT pl.doc_id, pl.i, cur, count(s.i) OVER (PARTITION BY pl.doc_id ORDER BY pl.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sent_id
  FROM pl LEFT JOIN stops s ON s.doc_id = pl.doc_id AND s.i = pl.i)"""


@query("t10_learned_sentences", f"""WITH {_SENTENCE_SQL}
SELECT doc_id, sent_id, md5(string_agg(cur, ' ' ORDER BY i)) AS h FROM tk GROUP BY doc_id, sent_id""")
def t10_learned_sentences(spark, d):
    """Sentences of all documents, abbreviations learned from the corpus."""
    s = se.split_sentences(Tables(spark, d).documents, "doc_id")
    return s.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.md5(F.array_join("tokens", " ")).alias("h"))


@query("s11_sentence_words", f"""WITH {_SENTENCE_SQL},
wd AS (SELECT doc_id, sent_id, i, lower(regexp_replace(cur, '^[^\\p{{L}}\\p{{Nd}}]+|[^\\p{{L}}\\p{{Nd}}]+$', '', 'g')) AS word FROM tk)
SELECT doc_id, sent_id, count(*) FILTER (WHERE word <> '') AS n_words, md5(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE word <> ''), '')) AS h
FROM wd GROUP BY doc_id, sent_id""")
def s11_sentence_words(spark, d):
    """The table of sentences and their lower-case words."""
    w = se.sentence_words(se.split_sentences(Tables(spark, d).documents, "doc_id"), "doc_id")
    return w.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("h"))
