"""Content-chosen anchors of fixed-length byte windows.

Every window of ``WINDOW`` bytes chooses the place of its ``GRAM``-byte gram with the least hash (the leftmost of equal
ones), so equal windows choose the same place. Windows that follow one another mostly agree: an anchor stands for the
run of windows that chose it, about one anchor in 35 bytes.
"""

from __future__ import annotations

import numpy as np

from wordlake.llm import textblocks as tb

WINDOW = 100
GRAM = 32
_PLACE = 27  # bits of a position within a block


def anchors(data: np.ndarray, offsets: np.ndarray, part_bytes: int = 1 << 18):
    """(position, first window, last window, gram hash) of the anchors of a block of texts; windows stay within a text.

    Worked out for about ``part_bytes`` at a time; a longer text in pieces that share ``WINDOW`` - 1 bytes, so each of
    its windows lies in one piece, and a run of windows that goes on behind a seam is one.
    """
    found, row, most = [], 0, max(WINDOW, min(part_bytes, (1 << _PLACE) - 1))
    while row < len(offsets) - 1:
        stop = min(len(offsets) - 1, max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1))
        begin, end = int(offsets[row]), int(offsets[stop])
        while end - begin > most:  # one text
            found.append(_moved(_anchors(data[begin : begin + most], np.array([0, most])), begin))
            begin += most - WINDOW + 1
        inner = np.concatenate(([0], offsets[row + 1 : stop] - begin, [end - begin]))
        found.append(_moved(_anchors(data[begin:end], inner), begin))
        row = stop
    if not found:
        return _anchors(data[:0], offsets[:1])
    place, first, last, gram = (np.concatenate(x) for x in zip(*found))
    # windows of two texts never choose one place, so a place met again goes on behind a seam
    new = np.concatenate(([True], place[1:] != place[:-1]))[: len(place)]
    return place[new], first[new], last[np.append(new[1:], True)[: len(place)]], gram[new]


def _moved(found, begin: int):
    *places, gram = found
    return [*(p + begin for p in places), gram]


def _anchors(data: np.ndarray, offsets: np.ndarray):
    n, none = len(data), np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(tb.U64)
    at = np.arange(n - GRAM + 1)
    gram = tb.SpanHash(data)(at, at + GRAM)
    low = (gram >> tb.U64(_PLACE) << tb.U64(_PLACE)) | at.astype(tb.U64)
    span, reach = WINDOW - GRAM + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: n - WINDOW + 1], low[span - reach : span - reach + n - WINDOW + 1])
    start = np.arange(n - WINDOW + 1)
    row = np.searchsorted(offsets, start, "right") - 1
    start = start[start + WINDOW <= offsets[row + 1]]
    place = (low[start] & tb.U64((1 << _PLACE) - 1)).astype(np.int64)
    if not len(start):
        return none, none, none, none.astype(tb.U64)
    cut = np.concatenate(([0], np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)) + 1, [len(start)]))
    return place[cut[:-1]], start[cut[:-1]], start[cut[1:] - 1], gram[place[cut[:-1]]]
