"""Periodic runs of words by maximal-pair enumeration over LCP-interval trees, and the texts with their repeats taken out."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.common import chunks, text_buffers, word_lists
from citegrove.llm.suffix_order import dense, refined


def suffix_levels(word: np.ndarray, row: np.ndarray, end: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The ranks of the suffixes by 1, 2, 4, ... words (level k: equal only where 2^k words are, within one row) and, in order of
    the last ranks, the suffixes that can share `least` words with another one of their row."""
    levels, shared = [], np.arange(len(word))
    for rank, open_ in refined(dense(row, word), end):
        levels.append(rank)
        if 1 << (len(levels) - 1) <= least:
            shared = open_
    return levels, shared[np.argsort(levels[-1][shared], kind="stable")]


def shared_words(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes a and b have in common, by their ranks at falling lengths."""
    n = np.zeros(len(a), np.int64)
    last = len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + n, last)] == levels[k][np.minimum(b + n, last)]
        n[same] += 1 << k
    return n


def near_ones(order: np.ndarray, lcp: np.ndarray, least: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Only the suffixes that can be in a pair: some other one with `least` equal words stands near enough for the longest match
    that the suffix has. lcp[i] is that of suffix i - 1 and i of the order."""
    group = np.cumsum(lcp < least)
    most = np.maximum(lcp, np.append(lcp[1:], 0))
    by = np.lexsort((order, group))
    step = np.full(len(order) + 1, np.iinfo(np.int64).max // (2 * share))
    step[1:-1] = np.where(group[by][1:] == group[by][:-1], np.diff(order[by]), step[0])
    near = np.empty(len(order), np.int64)
    near[by] = np.minimum(step[:-1], step[1:])
    kept = np.flatnonzero(near * share <= most)
    if not len(kept):
        return order[:0], lcp[:0]
    between = np.minimum.reduceat(lcp[:kept[-1] + 1], np.append(0, kept[:-1] + 1))
    between[0] = 0
    return order[kept], np.where(between < least, 0, between)


def maximal_pairs(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, share: int, least: int):
    """(start, length, period) of the maximal pairs whose places lie at most lcp / share apart and span `least` words.

    The LCP intervals are visited bottom-up. An interval's list holds the places of its suffixes in order, each with the class of
    the word to its left; the smaller list joins the larger one. A pair across two children differs on the right; it is one only
    if the classes differ as well. Occurrences of a string that lie within a third of its length form a progression, of which all
    but the first have the same word to their left: so only the next place on each side can hold the smallest period."""
    found: dict[tuple[int, int], int] = {}
    left = left.tolist()

    def joined(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        far = depth // share
        for x in b:
            i = bisect_left(a, x)
            for y in (a[i - 1] if i else None, a[i] if i < len(a) else None):
                if y is None:
                    continue
                q = abs(x - y)
                if q <= far and q + depth >= least and left[x] != left[y]:
                    key = (min(x, y), q + depth)
                    if found.get(key, q) >= q:
                        found[key] = q
        if len(b) * 8 < len(a):
            for x in b:
                insort(a, x)
            return a
        return sorted(a + b)

    stack: list[tuple[int, list[int]]] = []
    for place, depth in zip(order.tolist(), [*lcp[1:].tolist(), 0], strict=True):
        own = [place]
        while stack and stack[-1][0] > depth:
            inner, held = stack.pop()
            own = joined(held, own, inner)
        if depth:
            if stack and stack[-1][0] == depth:
                own = joined(stack.pop()[1], own, depth)
            stack.append((depth, own))
    return [(start, length, period) for (start, length), period in found.items()]


def runs_of(word: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """(start, length, period) of all runs, by start and period; places count over all rows."""
    n = len(word)
    share = min_exponent - 1
    # the two places of a run share at least this many words, whatever the period
    least = max(share, min(max(share * q, min_length - q) for q in range(1, min_length + 1)))
    if n <= least:
        return np.zeros((0, 3), np.int64)
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    levels, order = suffix_levels(word, row, np.repeat(bounds[1:], size), least)
    if not len(order):
        return np.zeros((0, 3), np.int64)
    lcp = np.append(0, shared_words(levels, order[:-1], order[1:]))
    order, lcp = near_ones(order, lcp, least, share)
    if not len(order):
        return np.zeros((0, 3), np.int64)
    left = np.append(-1, word)[np.arange(n)].astype(np.int64)
    first = bounds[:-1][size > 0]
    left[first] = -1 - first
    runs = np.array(maximal_pairs(order, lcp, left, share, min_length), np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, runs (start, length, period of every run, by start, then period; places are word
    numbers from 0) and collapsed (the words that no run holds after its first period, joined by one space).

    A run is a stretch of words with smallest period q, of at least min_length words and min_exponent (2 or more) periods, that no
    neighbouring word extends. Words are separated by ASCII white space and compared exactly. A null text has no words and the
    empty collapsed text; repeated rows give repeated rows, a null identifier stays null; an empty table gives no rows; other columns
    are ignored. A map job: documents are read in chunks of 1 MB, a longer one by itself, with about 100 bytes of memory a word and
    level of doubling."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("min_exponent and min_length are 2 or more")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words, bounds = word_lists(texts)
        word = words.dictionary_encode().indices.to_numpy()
        runs = runs_of(word, bounds, min_length, min_exponent)
        gone = np.zeros(len(word) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        stays = np.cumsum(gone)[:-1] == 0
        kept = np.append(0, np.cumsum(stays))[bounds]
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(stays)).cast(pa.string())), " ")
        of = np.searchsorted(runs[:, 0], bounds)
        row = np.searchsorted(bounds, runs[:, 0], "right") - 1
        items = pa.StructArray.from_arrays([pa.array(runs[:, 0] - bounds[row]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(run))
        lists = pa.ListArray.from_arrays(pa.array(of, pa.int32()), items)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), lists, collapsed], [id_col, "n_words", "runs", "collapsed"])

    def find(batches):
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                yield one(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))

    rows = docs.select(F.col(id_col), F.col(text).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(find, f"`{id_col}` {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
