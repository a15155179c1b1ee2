"""Registered text, tokenization and vocabulary queries (flagship first)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordlake.functions import arrays as ar
from wordlake.functions import text as tx
from wordlake.operators import vocab as vb
from wordlake.plans import sqlfrag as q
from wordlake.plans.registry import Tables, query


def top_english_terms(spark, sf_dir, k: int = 20):
    """Flagship (P5 + T1-T3 + A3 + W7 + O3): top-k terms of English documents."""
    t = Tables(spark, sf_dir)
    words = t.documents.where(F.col("lang") == "en").select(
        "doc_id", tx.clean_words("text").alias("words"))
    toks = vb.token_table(words, "words", "doc_id")
    top = vb.frequencies(toks).orderBy(F.desc("freq"), F.desc("symbol")).limit(k)
    return top.select("symbol", "freq",
                      (F.row_number().over(Window.orderBy(F.desc("freq"), F.desc("symbol"))) - 1)
                      .cast("long").alias("idx"))


FLAGSHIP_SQL = f"""
WITH toks AS (
  SELECT unnest({q.clean_words('text')}) AS symbol FROM documents WHERE lang = 'en'
)
SELECT symbol, count(*) AS freq,
       row_number() OVER (ORDER BY count(*) DESC, symbol DESC) - 1 AS idx
FROM toks GROUP BY symbol ORDER BY freq DESC, symbol DESC LIMIT 20
"""

query("a03_top_english_terms", FLAGSHIP_SQL)(top_english_terms)


# ---------------------------------------------------------------- text (T)

_TITLE = r"<title>(.*?)</title>"


def _link_posts(t):
    """A link post per page: its URL followed by its <title> text."""
    return t.pages.select("page_id", F.concat_ws(" ", "url", F.regexp_extract("html", _TITLE, 1)).alias("message"))


_LINK_POSTS_SQL = f"(SELECT page_id, concat_ws(' ', url, regexp_extract(html, '{_TITLE}', 1)) AS message FROM pages)"


@query("t01_strip_links", f"""SELECT page_id, md5({q.strip_links('message')}) AS h,
  CAST(length({q.strip_links('message')}) AS INTEGER) AS n FROM {_LINK_POSTS_SQL}""")
def t01_strip_links(spark, d):
    """Remove links from link posts."""
    m = _link_posts(Tables(spark, d))
    s = tx.strip_links("message")
    return m.select("page_id", F.md5(s).alias("h"), F.length(s).alias("n"))


@query("t02_letters_only", f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, md5(array_to_string(w, ' ')) AS h
FROM (SELECT doc_id, {q.letters_only_words('text')} AS w FROM documents)""")
def t02_letters_only(spark, d):
    """Letters only, lower case, whitespace split."""
    w = Tables(spark, d).documents.select("doc_id", tx.letters_only_words("text").alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("h"))


@query("t03_stop_words", f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_kept, md5(array_to_string(w, ' ')) AS h
FROM (SELECT doc_id, {q.remove_stops(q.letters_only_words('text'))} AS w FROM documents)""")
def t03_stop_words(spark, d):
    """Stop-word removal keeping order and duplicates."""
    w = Tables(spark, d).documents.select("doc_id", tx.remove_stop_words(tx.letters_only_words("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_kept"), F.md5(F.array_join("w", " ")).alias("h"))


@query("t05_tokenize", f"""SELECT token, count(*) AS n FROM
  (SELECT unnest({q.regexp_tokens('text')}) AS token FROM documents) GROUP BY token""")
def t05_tokenize(spark, d):
    """T5: regex tokenizer (\\w+ | $amounts | other non-space runs), token counts."""
    toks = Tables(spark, d).documents.select(F.explode(tx.regexp_tokens("text")).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("t06_whitespace", """SELECT conv_id, turn, CAST(len(string_split(lower(text), ' ')) AS INTEGER) AS n_tokens,
  CAST(len(list_filter(string_split(lower(text), ' '), lambda t: t = '')) AS INTEGER) AS n_empty FROM conversations""")
def t06_whitespace(spark, d):
    """Lower + split on single spaces (empty tokens kept)."""
    c = Tables(spark, d).conversations.select("conv_id", "turn", tx.whitespace_tokens("text").alias("w"))
    return c.select("conv_id", "turn", F.size("w").alias("n_tokens"),
                    F.size(F.filter("w", lambda t: t == "")).alias("n_empty"))


_KF = tx.KERAS_FILTERS
_KERAS_SQL = (f"list_filter(string_split(translate(lower(text), '{_KF}', '{' ' * len(_KF)}'), ' '), "
              f"lambda t: t <> '')")


@query("t07_keras_vocab", f"""WITH w AS (SELECT doc_id, {_KERAS_SQL} AS w FROM documents),
t AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM w),
f AS (SELECT token AS symbol, count(*) AS freq, min((doc_id, pos)) AS first FROM t GROUP BY token)
SELECT symbol, freq, row_number() OVER (ORDER BY freq DESC, first) AS idx FROM f""")
def t07_keras_vocab(spark, d):
    """Keras-style word index: filters, lower, split; index from 1 by
    count desc, ties by first appearance."""
    w = Tables(spark, d).documents.select("doc_id", tx.keras_words("text").alias("w"))
    toks = vb.token_table(w, "w", "doc_id")
    return vb.keras_index(toks, ["doc_id", "pos"]).select("symbol", "freq", "idx")


@query("t08_penn_tokens")
def t08_penn_tokens(spark, d):
    """Treebank-style tokens (contractions, punctuation) -> counts.
    Look-ahead patterns have no RE2 twin: rows-only check."""
    toks = Tables(spark, d).documents.select(F.explode(tx.penn_tokens("text")).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("t10_sentences", f"""SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_id, md5(unnest(s)) AS h
FROM (SELECT doc_id, {q.sentences('text')} AS s FROM documents)""")
def t10_sentences(spark, d):
    """Sentence split (trimmed, empty dropped), one row per sentence."""
    s = Tables(spark, d).documents.select("doc_id", F.posexplode(tx.sentences("text")).alias("sent_id", "s"))
    return s.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.md5("s").alias("h"))


@query("t11_html_text", f"""SELECT page_id, md5({q.html_to_text('html')}) AS h,
  CAST(length({q.html_to_text('html')}) AS INTEGER) AS n FROM pages""")
def t11_html_text(spark, d):
    """HTML to text (script/style bodies and tags dropped, entities unescaped)."""
    p = Tables(spark, d).pages.select("page_id", tx.html_to_text("html").alias("t"))
    return p.select("page_id", F.md5("t").alias("h"), F.length("t").alias("n"))


@query("t12_headline_words", f"""SELECT page_id, CAST(len(w) AS INTEGER) AS n_words, md5(array_to_string(w, ' ')) AS h FROM
  (SELECT page_id, {q.remove_stops(q.letters_only_words(q.html_to_text('html')))} AS w FROM pages)""")
def t12_headline_words(spark, d):
    """HTML -> words -> stop words removed."""
    p = Tables(spark, d).pages.select("page_id", tx.headline_words("html").alias("w"))
    return p.select("page_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("h"))


@query("t13_lower", "SELECT conv_id, turn, md5(lower(text)) AS h FROM conversations")
def t13_lower(spark, d):
    """Lowercase cells."""
    c = Tables(spark, d).conversations
    return c.select("conv_id", "turn", F.md5(tx.to_lower("text")).alias("h"))


@query("t14_token_count", f"SELECT doc_id, CAST(len({q.regexp_tokens('text')}) AS INTEGER) AS n_tokens FROM documents")
def t14_token_count(spark, d):
    """Token count per row."""
    return Tables(spark, d).documents.select("doc_id", tx.token_count(tx.regexp_tokens("text")).alias("n_tokens"))


@query("t15_char_freq", """SELECT ch, count(*) AS n FROM
  (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ch""")
def t15_char_freq(spark, d):
    """T15 + A3: character explode and character frequencies."""
    c = Tables(spark, d).documents.select(F.explode(tx.characters("text")).alias("ch"))
    return c.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@query("t16_printable", """SELECT doc_id, CAST(length(regexp_replace(text, '[^\\x09-\\x0d\\x20-\\x7e]', '', 'g')) AS INTEGER) AS n
FROM documents""")
def t16_printable(spark, d):
    """Strip to printable ASCII."""
    return Tables(spark, d).documents.select("doc_id", F.length(tx.printable_ascii("text")).alias("n"))


# ------------------------------------------------------ vocabulary (W7, V)

def _doc_words(t):
    return t.documents.select("doc_id", tx.letters_only_words("text").alias("w"))


_DOC_TOKENS_SQL = f"""(SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token
  FROM (SELECT doc_id, {q.letters_only_words('text')} AS w FROM documents))"""


@query("w07_vocab", f"""SELECT token AS symbol, count(*) AS freq,
  row_number() OVER (ORDER BY count(*) DESC, token DESC) - 1 AS idx FROM {_DOC_TOKENS_SQL} GROUP BY token""")
def w07_vocab(spark, d):
    """Frequency vocabulary, idx by (freq desc, symbol desc)."""
    toks = vb.token_table(_doc_words(Tables(spark, d)), "w", "doc_id")
    return vb.frequency_vocabulary(toks).select("symbol", "freq", "idx")


@query("w08_first_index", f"""SELECT token AS symbol, count(*) AS freq,
  row_number() OVER (ORDER BY min((doc_id, pos))) - 1 AS idx FROM {_DOC_TOKENS_SQL} GROUP BY token""")
def w08_first_index(spark, d):
    """Index by first appearance in (doc_id, pos) order."""
    toks = vb.token_table(_doc_words(Tables(spark, d)), "w", "doc_id")
    return vb.first_appearance_index(toks, ["doc_id", "pos"]).select("symbol", "freq", "idx")


_CONV_TOKENS_SQL = f"""(SELECT conv_id, turn, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token
  FROM (SELECT conv_id, turn, {q.letters_only_words('text')} AS w FROM conversations))"""


@query("v02_vocab_specials", f"""WITH v AS (SELECT token AS symbol, count(*) AS freq,
  row_number() OVER (ORDER BY count(*) DESC, token DESC) - 1 AS idx FROM {_CONV_TOKENS_SQL} GROUP BY token)
SELECT * FROM v UNION ALL
SELECT s.symbol, 0 AS freq, (SELECT count(*) FROM v) + s.k AS idx
FROM (VALUES ('<UNK>', 0), ('<PAD>', 1), ('<GO>', 2)) s(symbol, k)""")
def v02_vocab_specials(spark, d):
    """V2 / V4: frequency vocabulary of conversations plus <UNK>, <PAD>, <GO>."""
    t = Tables(spark, d)
    w = t.conversations.select("conv_id", "turn", tx.letters_only_words("text").alias("w"))
    toks = vb.token_table(w, "w", ["conv_id", "turn"])
    return vb.with_specials(vb.frequency_vocabulary(toks))


_CAP = 1000
_CAPPED_SQL = f"""(WITH f AS (SELECT token AS symbol, count(*) AS freq FROM {_DOC_TOKENS_SQL} GROUP BY token),
top AS (SELECT symbol, freq, row_number() OVER (ORDER BY freq DESC, symbol DESC) AS idx
        FROM f ORDER BY freq DESC, symbol DESC LIMIT {_CAP - 1})
SELECT * FROM top UNION ALL
SELECT '<UNK>' AS symbol, (SELECT sum(freq) FROM f) - (SELECT sum(freq) FROM top) AS freq, 0 AS idx)"""


@query("v03_capped_vocab", f"SELECT symbol, CAST(freq AS BIGINT) AS freq, idx FROM {_CAPPED_SQL}")
def v03_capped_vocab(spark, d):
    """V3: UNK at 0 counting the tokens outside, then the N-1 most common."""
    toks = vb.token_table(_doc_words(Tables(spark, d)), "w", "doc_id")
    return vb.capped_vocabulary(toks, _CAP)


def _encoded_docs(t):
    words = _doc_words(t)
    toks = vb.token_table(words, "w", "doc_id")
    vocab = vb.capped_vocabulary(toks, _CAP)
    return vb.encode_rows(words, "w", vocab, "ids", unk_idx=0, keys="doc_id")


_ENC_SQL = f"""(WITH v AS {_CAPPED_SQL},
t AS {_DOC_TOKENS_SQL},
k AS (SELECT t.doc_id, list(coalesce(v.idx, 0) ORDER BY t.pos) AS ids
FROM t LEFT JOIN v ON t.token = v.symbol GROUP BY t.doc_id)
SELECT doc_id, coalesce(ids, CAST([] AS BIGINT[])) AS ids FROM documents LEFT JOIN k USING (doc_id))"""


@query("v05_encode", f"""SELECT doc_id, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ',')) AS h FROM {_ENC_SQL}""")
def v05_encode(spark, d):
    """Encode token sequences with a capped vocabulary (UNK = 0)."""
    e = _encoded_docs(Tables(spark, d))
    return e.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join("ids", ",")).alias("h"))


@query("v06_decode", f"""WITH v AS {_CAPPED_SQL}, e AS {_ENC_SQL},
x AS (SELECT doc_id, generate_subscripts(ids, 1) AS pos, unnest(ids) AS id FROM e),
y AS (SELECT doc_id, string_agg(CASE WHEN id = 0 THEN '<UNK>' ELSE v.symbol END, ' ' ORDER BY pos) AS s
FROM x LEFT JOIN v ON x.id = v.idx GROUP BY doc_id)
SELECT doc_id, md5(coalesce(s, '')) AS h FROM e LEFT JOIN y USING (doc_id)""")
def v06_decode(spark, d):
    """V6: decode indices back to symbols (0 -> <UNK>)."""
    t = Tables(spark, d)
    words = _doc_words(t)
    vocab = vb.capped_vocabulary(vb.token_table(words, "w", "doc_id"), _CAP)
    enc = vb.encode_rows(words, "w", vocab, "ids", unk_idx=0, keys="doc_id")
    dec = vb.decode_arrays(enc, "ids", vocab.where(F.col("idx") > 0), "<UNK>", "sym", keys="doc_id")
    return dec.select("doc_id", F.md5(F.array_join("sym", " ")).alias("h"))


@query("v07_pad", f"""SELECT doc_id, array_to_string(CASE WHEN len(ids) >= 25 THEN ids[len(ids) - 24:]
  ELSE list_concat(list_transform(range(25 - len(ids)), lambda x: 0), ids) END, ',') AS ids
FROM {_ENC_SQL}""")
def v07_pad(spark, d):
    """V7: pad left / truncate left to 25 ids."""
    e = _encoded_docs(Tables(spark, d))
    return e.select("doc_id", ar.int_array_string(ar.pad_left("ids", 25)).alias("ids"))
