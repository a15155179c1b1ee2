"""DuckDB SQL fragments used by the oracle queries.

DuckDB uses RE2: no look-around, ASCII ``\\w``; Unicode word characters
are spelled ``[\\p{L}\\p{Nd}_]``. Lambdas use the ``lambda x: ...`` form.
"""

from wordlake.functions.stopwords import sql_list
from wordlake.functions.text import NAMED_ENTITIES

W = r"[\p{L}\p{Nd}_]"
# fixed values: DuckDB spellings of the text patterns in functions/text.py
LINK_SQL = r"[\p{L}\p{Nd}_]+:/{2}[\p{Nd}\p{L}_-]+(\.[\p{Nd}\p{L}_-]+)*(?:(?:/[^\s/]*))*"
TOKEN_SQL = r"[\p{L}\p{Nd}_]+|\$[\p{Nd}.]+|\S+"
BOW_SQL = r"[\p{L}\p{Nd}_][\p{L}\p{Nd}_]+"
STOPS = f"[{sql_list()}]"


def strip_links(x: str) -> str:
    return f"regexp_replace({x}, '{LINK_SQL}', '', 'g')"


def letters_only_words(x: str) -> str:
    s = f"lower(regexp_replace({x}, '[^a-zA-Z]', ' ', 'g'))"
    return f"list_filter(string_split_regex(trim({s}), ' +'), lambda t: t <> '')"


def remove_stops(arr: str) -> str:
    return f"list_filter({arr}, lambda t: NOT list_contains({STOPS}, t))"


def clean_words(x: str) -> str:
    return remove_stops(letters_only_words(strip_links(x)))


def regexp_tokens(x: str, pattern: str = TOKEN_SQL) -> str:
    return f"regexp_extract_all({x}, '{pattern}')"


def html_to_text(x: str) -> str:
    s = f"regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
    s = f"regexp_replace({s}, '<[^>]*>', '', 'g')"
    for name, ch in {**NAMED_ENTITIES, "amp": "&"}.items():
        s = f"replace({s}, '&{name};', '{2 * ch if ch == chr(39) else ch}')"
    return s


def sentences(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?]+[.!?]*'), "
            f"lambda s: trim(s)), lambda s: s <> '')")


def r6(x: str) -> str:
    return f"round({x}, 6)"
