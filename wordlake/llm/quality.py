"""Operator 2, quality rules: compression bands.

zstandard ratios (bytes / compressed bytes) of the whole document and of fixed chunks are held against limits that
depend on the length: repetitive text compresses too well, keys, dumps and noise hardly at all. Short texts compress
badly for want of context, so the band widens downwards with fewer bytes and closes below ``128`` bytes altogether. The
lowest ratios lie above what random words over 62 symbols reach at the longest length of their step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordlake.llm import textblocks as tb

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Bands:
    """Lowest and highest ratio from a length on; a ratio outside is rejected."""

    #: (from so many bytes, lowest ratio, highest ratio), rising.
    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 4.0), (128, 1.2, 3.0), (384, 1.235, 3.0), (448, 1.25, 3.0), (512, 1.265, 3.25), (576, 1.28, 3.25),
        (640, 1.3, 3.25), (768, 1.32, 3.25), (896, 1.335, 3.25), (1024, 1.37, 3.5), (2048, 1.4, 4.0), (8192, 1.45, 4.5),
        (32768, 1.5, 5.0))
    chunk_bytes: int = 2048
    #: Shorter rests at the end of a document are left to the whole document's ratio.
    least_chunk: int = 1024
    #: A document is rejected when more than this share of its chunks is outside.
    bad_share: float = 0.25
    level: int = 3

    def band(self, n: int) -> tuple[float, float]:
        return next((lo, hi) for at, lo, hi in reversed(self.limits) if n >= at)


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
    "base_failed boolean, ratio double, n_chunks long, n_chunks_high long, n_chunks_low long, verdict string, kept boolean"


def _compression(raw: bytes, bands: Bands, squeeze) -> tuple[float, int, int, int]:
    ratio = len(raw) / len(squeeze(raw)) if raw else 0.0
    chunks = [raw[k : k + bands.chunk_bytes] for k in range(0, len(raw), bands.chunk_bytes)]
    each = [(len(c) / len(squeeze(c)), *bands.band(len(c))) for c in chunks if len(c) >= bands.least_chunk]
    return ratio, len(each), sum(r > hi for r, _, hi in each), sum(r < lo for r, lo, _ in each)


def _base(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    rows, w = len(offsets) - 1, tb.words(data, offsets)
    letters = tb.per_row(((data & 0xC0) != 0x80) & ~tb._SEPARATOR[data], offsets)
    # lines: a line ends at \n or with its row
    cut = np.unique(np.concatenate((np.flatnonzero(data == 10) + 1, offsets)))
    begin, stop = cut[:-1], cut[1:]
    held = np.diff(np.searchsorted(w.start, cut)) > 0
    begin, stop = begin[held], stop[held]
    if len(begin):
        stop = stop - (data[stop - 1] == 10)
    row = np.searchsorted(offsets, begin, "right") - 1
    _, first = np.unique(tb.with_row(row, tb.SpanHash(data)(begin, stop)), return_index=True)
    lines = np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)
    # words in 3-word windows that occur twice or more
    at, value = tb.ngrams(w, 3)
    _, inverse, count = np.unique(tb.with_row(w.row[at], value), return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    covered = np.zeros(len(w.row), bool)
    for k in range(3):
        covered[twice + k] = True
    return {"n_words": np.bincount(w.row, minlength=rows), "word_chars": letters, "n_symbols": tb.per_row(_SYMBOL[data], offsets),
            "n_dup_lines": lines, "n_repeat_words": np.bincount(w.row[covered], minlength=rows)}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands(),
                  keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row with the base counts, the ratios and the verdict; no shuffle.

    A null text counts as an empty one: no words, ``base_failed``. Repeated rows and equal ids are judged row by row;
    other columns are not read, but those named in ``keep`` pass through as ``in_<name>``. ``verdict`` is ``base``, ``repetitive``, ``incompressible`` or
    ``ok``; ``kept`` is true for ``ok`` alone.
    """

    picked = docs.select(F.col(id_col).cast("long"), text_col, *(F.col(c).alias(f"in_{c}") for c in keep))
    passed = picked.schema.fields[2:]
    fields = T.StructType([*T.StructType.fromDDL(FIELDS).fields, *passed])

    def judge(batches):
        squeeze = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            for lo, hi, data, offsets in tb.blocks(batch.column(1), 1 << 20):
                base = _base(data, offsets)
                whole = memoryview(data)
                z = [_compression(bytes(whole[offsets[i] : offsets[i + 1]]), bands, squeeze) for i in range(hi - lo)]
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                verdict = []
                for i, (ratio, n, high, low) in enumerate(z):
                    least, most = bands.band(int(offsets[i + 1] - offsets[i]))
                    if failed[i]:
                        verdict.append("base")
                    elif ratio > most or high > bands.bad_share * n:
                        verdict.append("repetitive")
                    elif ratio < least or low > bands.bad_share * n:
                        verdict.append("incompressible")
                    else:
                        verdict.append("ok")
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(v.astype(np.int64)) for v in base.values()), pa.array(failed),
                        pa.array([x[0] for x in z], pa.float64()), *(pa.array([x[k] for x in z], pa.int64()) for k in (1, 2, 3)),
                        pa.array(verdict, pa.string()), pa.array([v == "ok" for v in verdict], pa.bool_()),
                        *(c.slice(lo, hi - lo) for c in batch.columns[2:])]
                yield pa.RecordBatch.from_arrays(cols, names=fields.names)

    return picked.mapInArrow(tb.trimmed(judge), fields)
