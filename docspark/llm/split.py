"""Splitting oversized texts at natural boundaries by pointer doubling.

Every boundary of a text (paragraph, line, sentence and word ends; hard ones only
inside stretches that have none) is joined to its farthest legal successor: step back
by the overlap to a word start, then take the best boundary within the limit from
there. The join is a sorted merge of the boundary array with itself, one array per
text. Squaring the successor table gives the 2nd, 4th, 8th ... cut from every
boundary; the cuts of the text are those reached from position 0, found in
log2(pieces) rounds instead of one cut after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS = 500
OVERLAP_TOKENS = 50
CHARS_PER_TOKEN = 4
#: Inside a stretch without natural boundaries longer than this (or half of what a piece adds) hard boundaries stand that far apart.
HARD_STEP = 250

_WORD = re.compile(r"\S+")
#: What may close a sentence after its mark.
_CLOSERS = "\"'”’»)]"
_MARKS = (".", "!", "?", "…")

SCHEMA = "item_table string, item_id string, digest string, piece_no int, n_pieces int, start int, end int, overlap int, token_count int, text string"


def boundaries(text: str, step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End positions, their rank (0 hard, 1 word, 2 sentence, 3 line, 4 paragraph) and the word starts of ``text``."""
    ends, ranks, starts = [0], [1], []
    spans = [m.span() for m in _WORD.finditer(text)]
    for k, (s, e) in enumerate(spans):
        starts.append(s)
        nxt = spans[k + 1][0] if k + 1 < len(spans) else len(text)
        lines = text.count("\n", e, nxt) or text.count("\r", e, nxt)
        rank = 4 if lines > 1 else 3 if lines else 2 if text[s:e].rstrip(_CLOSERS).endswith(_MARKS) else 1
        ends.append(e)
        ranks.append(rank)
    if ends[-1] != len(text):
        ends.append(len(text))
        ranks.append(1)
    at, rank = np.array(ends), np.array(ranks)
    long = np.flatnonzero(np.diff(at) > step)
    if len(long):
        hard = np.concatenate([np.arange(at[i] + step, at[i + 1], step) for i in long])
        order = np.argsort(np.concatenate([at, hard]), kind="stable")
        rank = np.concatenate([rank, np.zeros(len(hard), dtype=rank.dtype)])[order]
        at = np.concatenate([at, hard])[order]
    return at, rank, np.array(starts, dtype=at.dtype)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``text``: at most ``limit`` characters each, at most ``overlap`` repeated."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    at, rank, starts = boundaries(text, min(HARD_STEP, max(1, (limit - overlap) // 2)))
    # where the piece after a cut starts: the first word start within the overlap, else as far back as allowed
    back = np.maximum(at - overlap, 0)
    k = np.searchsorted(starts, back)
    begin = np.where(k < len(starts), starts[np.minimum(k, len(starts) - 1)], n) if len(starts) else np.full(len(at), n)
    begin = np.where(begin < at, begin, back)
    begin[0] = 0
    reach = begin + limit
    last = len(at) - 1
    succ = np.full(len(at), -1)
    here = np.arange(len(at))
    for least_rank, fill in ((3, limit // 2), (2, limit // 2), (1, 0), (0, 0)):
        some = np.flatnonzero(rank >= least_rank)
        if not len(some):
            continue
        far = some[np.maximum(np.searchsorted(at[some], reach, side="right") - 1, 0)]
        ok = (succ < 0) & (far > here) & (at[far] >= begin + fill) & (at[far] <= reach)
        succ[ok] = far[ok]
    succ[reach >= n] = last
    succ[last] = last
    seen, table = np.array([0]), succ
    while table[0] != last:
        seen = np.union1d(seen, table[seen])
        table = table[table]
    seen = np.union1d(seen, table[seen])
    seen = np.unique(np.concatenate([seen, succ[seen]]))
    ends = at[seen]
    return [(int(begin[seen[i]]), int(ends[i + 1])) for i in range(len(seen) - 1)]


def _splitter(limit_tokens: int, overlap_tokens: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    limit, overlap = limit_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1, overlap_tokens * CHARS_PER_TOKEN

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for name, item, digest, text in zip(pdf["item_table"], pdf["item_id"], pdf["digest"], pdf["text"]):
                pieces = cut(text, limit, overlap)
                for i, (s, e) in enumerate(pieces):
                    rows.append((name, item, digest, i, len(pieces), s, e, pieces[i - 1][1] - s if i else 0, (e - s) // CHARS_PER_TOKEN, text[s:e]))
                    held += e - s
                if held > 8_000_000:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return split


def split_oversized(items: DataFrame, limit_tokens: int = LIMIT_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """``items(item_table, item_id, text)`` -> ordered pieces of those above ``limit_tokens``.

    Tokens are code points divided by 4, rounded down. ``start`` and ``end`` are code points;
    a piece repeats the last ``overlap`` characters of the one before, so the text is the
    first piece followed by every later one without its overlap. Null and empty texts and those
    within the limit give no piece. Rows with the same id and text count once; the same id with
    another text is another item, told apart by ``digest``. Texts without any blank are cut hard. Null ids stay null.
    """
    big = items.select("item_table", "item_id", "text").where(F.floor(F.length("text") / CHARS_PER_TOKEN) > limit_tokens)
    # repeats are found by a digest, so that equal texts aren't compared as grouping keys
    once = big.groupBy("item_table", "item_id", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"))
    return once.mapInPandas(_splitter(limit_tokens, overlap_tokens), SCHEMA)
