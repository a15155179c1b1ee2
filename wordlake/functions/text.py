"""Text column functions (T1-T19): pure Column -> Column expressions.

All of them compile to JVM regex / array expressions inside whole-stage
codegen; none uses a Python UDF. Patterns are Java regex; ``(?U)`` makes
``\\w``/``\\d`` Unicode-aware, as Python 3 ``re`` is by default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordlake.functions.stopwords import ENGLISH_STOP_WORDS

# fixed values: patterns whose matches must equal the reference's
LINK_PATTERN = r"(?U)\w+:\/{2}[\d\w-]+(\.[\d\w-]+)*(?:(?:\/[^\s/]*))*"
TOKEN_PATTERN = r"(?U)\w+|\$[\d\.]+|\S+"
NON_LETTERS = r"[^a-zA-Z]"
SENTENCE_PATTERN = r"[^.!?]+[.!?]*"
SCRIPT_STYLE = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
TAG = r"<[^>]*>"
NOT_PRINTABLE = r"[^\x09-\x0d\x20-\x7e]"
BOW_TOKEN = r"(?U)\b\w\w+\b"
# fixed values: named HTML entities and their characters (&amp; is decoded last)
NAMED_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae",
                  "trade": "\u2122", "hellip": "\u2026", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018",
                  "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb",
                  "bull": "\u2022", "middot": "\u00b7", "deg": "\u00b0", "sect": "\u00a7", "times": "\u00d7",
                  "cent": "\u00a2", "pound": "\u00a3", "euro": "\u20ac"}
KERAS_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"
# Treebank-like word tokenizer (re-aimed from external tokenizers): a word
# that ends in n't splits before it, clitics 's 'm 'd 'll 're 've split off,
# numbers keep inner . and , and every other non-space symbol stands alone.
# Inner hyphens, abbreviations of single letters, dashes and dots in a row stay whole.
PENN_PATTERN = (r"(?iU)\w+(?:-\w+)*?(?=n't\b)|n't\b|'(?:s|m|d|ll|re|ve)\b|(?:\b\p{L}\.){2,}"
                r"|\d+(?:[.,]\d+)+|\w+(?:-\w+)*|\.{3}|--|[^\w\s]")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_links(col) -> Column:
    """Remove URLs. A link needs '://': texts without it skip the regex
    (a byte search instead of a backtracking scan of every word)."""
    c = _c(col)
    return F.when(F.instr(c, "://") > 0, F.regexp_replace(c, LINK_PATTERN, "")).otherwise(c)


def letters_only_words(col) -> Column:
    """Non-letters -> space, lowercase, split on whitespace, drop ''."""
    # a run of non-letters becomes one space, so the split needs no pattern
    s = F.lower(F.regexp_replace(_c(col), NON_LETTERS + "+", " "))
    # after trim + split, '' only appears for an empty text;
    # array_remove is code-generated (a filter lambda would be interpreted)
    return F.array_remove(F.split(F.trim(s), " "), "")


def remove_stop_words(tokens, stops=ENGLISH_STOP_WORDS) -> Column:
    """Drop stop words, keeping duplicates and order (not array_except)."""
    # IN over > 10 literals is planned as a hash-set lookup (InSet)
    stops = list(stops)
    return F.filter(_c(tokens), lambda t: ~t.isin(stops))


def clean_words(col, stops=ENGLISH_STOP_WORDS) -> Column:
    """T1 -> T2 -> T3 (the cleaner without the stemming step)."""
    return remove_stop_words(letters_only_words(strip_links(col)), stops)


def regexp_tokens(col, pattern: str = TOKEN_PATTERN) -> Column:
    """T5: all regex matches, in order (findall semantics)."""
    return F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(0))


def whitespace_tokens(col) -> Column:
    """Lower + split on single spaces; empty tokens are kept."""
    return F.split(F.lower(_c(col)), " ")


def penn_tokens(col) -> Column:
    """Treebank-style tokens (contractions and punctuation split)."""
    return regexp_tokens(col, PENN_PATTERN)


def keras_words(col, filters: str = KERAS_FILTERS) -> Column:
    """T7 text part: punctuation -> space, lower, split on space, drop ''."""
    s = F.translate(F.lower(_c(col)), filters, " " * len(filters))
    return F.filter(F.split(s, " "), lambda t: t != "")


def bow_words(col) -> Column:
    """V12/V13 token pattern: runs of >= 2 word characters, lowercased."""
    return regexp_tokens(F.lower(_c(col)), BOW_TOKEN)


def sentences(col) -> Column:
    """Sentence strings (trimmed, empty dropped), in order."""
    parts = F.regexp_extract_all(_c(col), F.lit(SENTENCE_PATTERN), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def unescape_entities(col) -> Column:
    c = _c(col)
    for name, ch in NAMED_ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    # numbered entities: cut the text before each, decode the number that a piece begins with
    pieces = F.split(c, r"(?=&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)")
    decoded = F.array_join(F.transform(pieces, _decode_head), "")
    return F.replace(F.when(F.instr(c, "&#") > 0, decoded).otherwise(c), F.lit("&amp;"), F.lit("&"))


def _decode_head(piece) -> Column:
    number = F.regexp_extract(piece, r"^&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
    code = F.when(F.lower(number).startswith("x"), F.conv(F.substring(number, 2, 7), 16, 10)).otherwise(number).try_cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    ch = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(number == "", piece).otherwise(F.concat(ch, F.regexp_replace(piece, r"^&#[0-9a-fA-FxX]+;", "")))


def html_to_text(col) -> Column:
    """Drop script/style bodies and tags, unescape entities."""
    no_code = F.regexp_replace(_c(col), SCRIPT_STYLE, "")
    return unescape_entities(F.regexp_replace(no_code, TAG, ""))


def headline_words(col, stops=ENGLISH_STOP_WORDS) -> Column:
    """HTML -> letters-only words -> stop words removed (no stemming)."""
    return remove_stop_words(letters_only_words(html_to_text(col)), stops)


def to_lower(col) -> Column:
    """T13 (a plain string) or element-wise over an array of strings."""
    return F.lower(_c(col))


def lower_all(arr) -> Column:
    return F.transform(_c(arr), lambda t: F.lower(t))


def token_count(tokens) -> Column:
    """T14."""
    return F.size(_c(tokens))


def characters(col) -> Column:
    """The characters of a string, in order."""
    return F.split(_c(col), "")


def printable_ascii(col) -> Column:
    """Keep only printable ASCII (Python's string.printable)."""
    return F.regexp_replace(_c(col), NOT_PRINTABLE, "")


def join_tokens(tokens, sep: str = " ") -> Column:
    """T19."""
    return F.array_join(_c(tokens), sep)


def trigram_text(col) -> Column:
    """Letters only, lower case, padded with one space (input of trigrams)."""
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(_c(col), r"(?U)[^\p{L}]+", " ")), F.lit(" "))


def character_trigrams(col) -> Column:
    """Overlapping character trigrams in one linear regex pass (a zero-width
    look-ahead capturing the next three characters at every position);
    indexing with substring would rescan the UTF-8 text for every trigram."""
    return F.regexp_extract_all(_c(col), F.lit(r"(?s)(?=(.{3}))"), F.lit(1))
