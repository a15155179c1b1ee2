"""UDF surface (X1-X6): the slow path, used only where built-in expressions
cannot express the semantics. Everything is Arrow-batched (pandas UDFs,
mapInPandas, applyInPandas); nothing is a row-at-a-time Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _TextOnly(HTMLParser):
    """Collects text outside <script>/<style>, entities decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self._skip:
            self._skip -= 1

    def handle_data(self, data):
        if not self._skip:
            self.parts.append(data)


def html_text_exact(html: str | None) -> str | None:
    """T11 exact mode: the standard-library HTML parser's text."""
    if html is None:
        return None
    p = _TextOnly()
    p.feed(html)
    p.close()
    return "".join(p.parts)


def vectorized(fn: Callable, return_type=T.StringType()) -> Callable[[Column], Column]:
    """Wrap a per-value helper as an Arrow-batched pandas UDF."""
    @F.pandas_udf(return_type)
    def _udf(s: pd.Series) -> pd.Series:
        return s.map(fn)
    return _udf


def row_function(fn: Callable[[pd.DataFrame], pd.Series], return_type) -> Callable[[Column], Column]:
    """Wrap a function of several columns (a struct) as an Arrow-batched pandas UDF."""
    @F.pandas_udf(return_type)
    def _udf(rows: pd.DataFrame) -> pd.Series:
        return fn(rows)
    return _udf


html_text_udf = vectorized(html_text_exact)


def map_partitions(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Per-partition batch function (replaces a process-pool apply)."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def group_apply(df: DataFrame, keys, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Grouped aggregate in pandas; only for bounded groups (prefer agg)."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


# Pluggable dispatch by name (column -> column functions)
REGISTRY: dict[str, Callable[..., Column]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def dispatch(name: str, *args, **kw) -> Column:
    return REGISTRY[name](*args, **kw)


@register("html_exact")
def _html_exact(col) -> Column:
    return html_text_udf(F.col(col) if isinstance(col, str) else col)


@register("html_regex")
def _html_regex(col) -> Column:
    from wordlake.functions.text import html_to_text
    return html_to_text(col)
