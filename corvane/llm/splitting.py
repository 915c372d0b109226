"""Cutting oversized items at natural boundaries, with overlap.

Recursive bisection: a text is cut at the strongest boundary near its midpoint, each half that still exceeds the limit
minus the overlap is cut again, and the overlaps are attached last. Boundaries are found once per text by their
strength; each recursion only searches sorted positions, so a text of n characters takes O(n + pieces log n).

Defined results: null, empty and short texts are not items; a text without any boundary is cut at its midpoints, but
never between a base character and its combining mark; repeats of an item count once. The pieces without their overlaps,
joined, are the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2400, 200

#: Boundaries from strongest to weakest; a cut is at the end of the match.
_BOUNDARIES = tuple(
    regex.compile(p)
    for p in (
        r"\n[^\S\n]*\n\s*(?=\#{1,6}\s)|\n(?=\#{1,6}\s)",  # before a heading
        r"\n[^\S\n]*\n\s*",  # paragraph
        r"\n(?=\s*(?:[-*+•]|\d+[.)])\s)",  # list item
        r"(?:[.!?…]+[\"'»”’)\]]*(?:\s*\[\d+\])*\s+(?=[\p{Lu}\p{N}\"'«“‘(\[¿¡\-*#])|[。！？]+)",  # sentence
        r"\n",
        r"[;:,、，；]\s+|\s[–—]\s",  # clause
        r"\s+",
    )
)


def bodies(text: str, most: int, least: int = 1) -> list[int]:
    """The starts of the pieces' bodies, each of at most `most` and at least `least` characters; `most` is at least twice `least`."""
    if len(text) <= most:
        return [0]
    marks = [np.fromiter((m.end() for m in b.finditer(text)), np.int64) for b in _BOUNDARIES]
    starts, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            starts.append(lo)
            continue
        middle = (lo + hi) // 2
        # Away from the midpoint as far as a quarter of the text, less where that would leave more pieces than needed.
        reach = max(1, (hi - lo) // 4)
        cut = 0
        for m in marks:
            i, j = np.searchsorted(m, (max(lo + least, middle - reach), min(hi - least, middle + reach) + 1))
            if i < j:
                cut = int(m[i:j][np.argmin(np.abs(m[i:j] - middle))])
                break
        if not cut:
            cut = middle
            while cut > lo + least and unicodedata.combining(text[cut]):
                cut -= 1
        todo += [(cut, hi), (lo, cut)]
    return starts


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """The pieces of one text; each but the first starts with the last `overlap` characters of the one before."""
    if overlap < 0 or limit < max(3 * overlap, 1):
        raise ValueError("the limit must be three times the overlap at least")
    if len(text) <= limit:
        return [text]
    # No body is shorter than the overlap, so the overlap is always the end of the one piece before.
    starts = bodies(text, limit - overlap, max(1, overlap))
    return [text[max(0, a - (overlap if k else 0)) : b] for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)]))]


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_type, item, page_no, piece_no, start, piece) for each item longer than `limit`.

    Short items are dropped in the JVM, so only the oversized texts reach Python; nothing is shuffled but their repeats.
    """
    long = items.select("item_type", "item", "page_no", "text").filter(F.length("text") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for kind, item, page, text in df.itertuples(index=False):
                at = 0
                for k, piece in enumerate(cut(text, limit, overlap)):
                    start = at - overlap if k else 0
                    rows.append((kind, item, page, k + 1, start, piece))
                    at = start + len(piece)
            if rows:
                yield pd.DataFrame(rows, columns=["item_type", "item", "page_no", "piece_no", "start", "piece"])

    return long.mapInPandas(run, "item_type string, item string, page_no int, piece_no int, start int, piece string").distinct()


def oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_type, item, page_no): the items that were cut."""
    return split_oversized(items, limit, overlap).filter("piece_no = 1").select("item_type", "item", "page_no").distinct()
