"""Benchmark decontamination: an FM-index of every training shard, searched backward for all windows of the benchmark."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.common import chunks, stored, text_buffers, word_lists
from citegrove.llm.fm_index import FMIndex

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
PIECE_WORDS = 1 << 12
SHARD_BYTES = 4 << 20


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (digits, letters a-z read without regard to case, everything above ASCII) of all rows, and where each row's start."""
    data, offsets = text_buffers(texts)
    body = pa.py_buffer(_PLAIN[data].tobytes())
    return word_lists(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets).tobytes()), body))


def benchmark_pieces(benchmark: DataFrame, window: int, id_col: str, text: str) -> DataFrame:
    """(item, words): the words of each item, joined by blanks; long items in pieces that share window - 1 words."""
    def cut(batches):
        for batch in batches:
            words, bounds = plain_words(batch.column(1))
            names = batch.column(0).to_pylist()
            rows = [(name, words[at:min(at + PIECE_WORDS + window - 1, b)]) for name, a, b in zip(names, bounds, bounds[1:], strict=False)
                    for at in range(a, max(a, b - window) + 1 if b > a else a, PIECE_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([" ".join(r[1].to_pylist()) for r in rows], pa.string())], ["item", "words"])

    return benchmark.select(F.col(id_col).cast("string"), F.col(text).cast("string")).mapInArrow(cut, "item string, words string")


@dataclass
class Phrases:
    """The distinct windows of some benchmark pieces, as rows of word numbers by length, each with the items that hold it."""
    words: pa.Array
    windows: dict[int, np.ndarray]
    items: list[str]
    holders: dict[int, list[np.ndarray]]

    @classmethod
    def of(cls, rows: list, window: int) -> Phrases:
        words: dict[str, int] = {}
        items: dict[str, int] = {}
        held: dict[tuple[int, ...], set[int]] = {}
        for item, text in rows:
            ids = [words.setdefault(w, len(words) + 1) for w in text.split(" ")]
            for i in range(max(1, len(ids) - window + 1)):
                of = held.setdefault(tuple(ids[i:i + window]), set())
                if item is not None:
                    of.add(items.setdefault(item, len(items)))
        by_length: dict[int, list] = {}
        for key in held:
            by_length.setdefault(len(key), []).append(key)
        return cls(pa.array(list(words), pa.large_string()), {m: np.array(keys, np.int64) for m, keys in by_length.items()}, list(items),
                   {m: [np.array(sorted(held[k]), np.int64) for k in keys] for m, keys in by_length.items()})

    def occurrences(self, words: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of words, number of the window among those of its length) of each occurrence in a shard. Words that
        no window has are one separator, as are the ends of documents, and separators in a row are one: no window crosses them."""
        if not self.windows:
            return (np.zeros(0, np.int64),) * 3
        known = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        symbols = np.zeros(len(known) + len(bounds), np.int64)
        place = np.arange(len(known)) + np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
        symbols[place] = known
        source = np.full(len(symbols), -1)
        source[place] = np.arange(len(known))
        kept = symbols > 0
        kept[1:] |= symbols[:-1] > 0
        kept[0] = True
        symbols, source = symbols[kept], source[kept]
        if symbols[-1]:
            symbols, source = np.append(symbols, 0), np.append(source, -1)
        index = FMIndex(symbols, len(self.words))
        found = []
        for m, windows in self.windows.items():
            low, high = index.ranges(windows)
            n = high - low
            which = np.repeat(np.arange(len(n)), n)
            rows = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append((source[index.locate(rows)], np.full(len(rows), m), which))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def byte_spans(text: str, spans: list[tuple[int, int]]) -> tuple[list[dict], str]:
    """The spans with their bytes, and the text without them."""
    body = (text or "").encode()
    at = [(m.start(), m.end()) for m in _WORD.finditer(body)]
    out, kept, before = [], [], 0
    for first, last in spans:
        start, end = at[first][0], at[last - 1][1]
        out.append({"first": first, "last": last, "start_byte": start, "end_byte": end})
        kept.append(body[before:start])
        before = end
    return out, b"".join([*kept, body[before:]]).decode()


SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])
OUT = "n_words long, spans array<struct<first:bigint,last:bigint,start_byte:bigint,end_byte:bigint>>, items array<string>, kept string"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def shard_hits(phrases: Phrases, texts: pa.Array) -> tuple[np.ndarray, dict[int, tuple[list, list]]]:
    """Number of words of each row, and for the rows with a window: merged word spans and the sorted items."""
    words, bounds = plain_words(texts)
    first, size, which = phrases.occurrences(words, bounds)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + size, -1)
    hit = np.cumsum(cover)[:-1] > 0
    start = hit.copy()
    start[1:] &= ~hit[:-1]
    start[bounds[:-1][np.diff(bounds) > 0]] |= hit[bounds[:-1][np.diff(bounds) > 0]]
    stop = np.zeros(len(hit) + 1, bool)
    stop[1:] = hit & ~np.append(hit[1:], False)
    stop[bounds[1:][np.diff(bounds) > 0]] |= hit[bounds[1:][np.diff(bounds) > 0] - 1]
    edges = np.column_stack([np.flatnonzero(start), np.flatnonzero(stop)])
    of = np.searchsorted(bounds, first, "right") - 1
    found: dict[int, tuple[list, list]] = {}
    low = np.searchsorted(edges[:, 0], bounds)
    pairs = np.unique(np.column_stack([of, size, which]), axis=0)
    for row, group in zip(*groups(pairs[:, 0]), strict=True):
        held = np.unique(np.concatenate([phrases.holders[m][w] for m, w in pairs[group, 1:].tolist()]))
        found[int(row)] = ([tuple(x) for x in (edges[low[row]:low[row + 1]] - bounds[row]).tolist()], sorted(phrases.items[i] for i in held))
    return np.diff(bounds), found


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    at = np.append(np.flatnonzero(new), len(sorted_keys))
    return sorted_keys[at[:-1]], [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int, id_col: str, text: str):
    """The benchmark in blocks that fit a broadcast, one after the other; no more than one is held by the driver."""
    pieces = stored(benchmark_pieces(benchmark, window, id_col, text), "benchmark-pieces")
    size = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    count = -(-size // block_bytes) or 1
    for block in range(count):
        of_block = F.pmod(F.xxhash64("item", "words"), F.lit(count)) == block
        yield count, Phrases.of(pieces.filter(of_block).collect(), window)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, id_col: str = "doc_id",
                 text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, spans (merged stretches of words that lie in an occurrence of a window: first and
    last + 1 word, start and end byte), items (the items with such windows, sorted as strings) and kept (the text without the
    spans; null where nothing was found and the text stays as it is).

    Words are runs of digits, letters (A-Z read as a-z) and characters above ASCII. A window is `window` consecutive words of an item;
    an item of fewer words, but not none, is one window. Null texts have no words. Items with one identifier are one; an item without
    identifier marks words, but is not listed. Repeated rows of docs give repeated rows, a null identifier stays; empty tables give no rows
    or no hits; other columns are ignored.

    Every task indexes its documents in shards of 4 MB (a longer document is one by itself) and searches the windows there. A benchmark
    of more than block_bytes is searched block by block, so that no broadcast is larger; the answers are then joined by row."""
    if window < 1:
        raise ValueError("window is 1 or more")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    partial = []
    for count, phrases in phrase_blocks(benchmark, window, block_bytes, item_col, item_text):
        held = spark.sparkContext.broadcast(phrases)
        if count == 1:
            return rows.mapInArrow(lambda batches, held=held: whole(held.value, batches), f"id {kind}, {OUT}").withColumnRenamed("id", id_col)
        if not partial:
            rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        found = rows.select("row", "text").mapInArrow(lambda batches, held=held: part(held.value, batches),
                                                     "row long, spans array<struct<first:bigint,last:bigint>>, items array<string>")
        partial.append(stored(found, "hits"))
        held.destroy()
    hits = partial[0]
    for more in partial[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return rows.join(hits, "row", "left").select("id", "text", "spans", "items").mapInArrow(finish, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)


def whole(phrases: Phrases, batches):
    for batch in batches:
        _, offsets = text_buffers(batch.column(1))
        for a, b in chunks(offsets, SHARD_BYTES):
            texts = batch.column(1).slice(a, b - a)
            n_words, found = shard_hits(phrases, texts)
            yield results(batch.column(0).slice(a, b - a), texts, n_words, found)


def part(phrases: Phrases, batches):
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        _, offsets = text_buffers(batch.column(1))
        for a, b in chunks(offsets, SHARD_BYTES):
            _, found = shard_hits(phrases, batch.column(1).slice(a, b - a))
            at = sorted(found)
            spans = [[{"first": x, "last": y} for x, y in found[i][0]] for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(at, pa.int64())), pa.array(spans, kind),
                                              pa.array([found[i][1] for i in at], pa.list_(pa.string()))], ["row", "spans", "items"])


def finish(batches):
    for batch in batches:
        _, bounds = plain_words(batch.column(1))
        spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = {i: (merged([(x["first"], x["last"]) for x in s]), sorted(set(items[i]))) for i, s in enumerate(spans) if s}
        yield results(batch.column(0), batch.column(1), np.diff(bounds), found)


def results(ids: pa.Array, texts: pa.Array, n_words: np.ndarray, found: dict) -> pa.RecordBatch:
    spans, items, kept = [[]] * len(ids), [[]] * len(ids), [None] * len(ids)
    for i, (own, names) in found.items():
        spans[i], kept[i] = byte_spans(texts[i].as_py(), own)
        items[i] = names
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(items, pa.list_(pa.string())),
                                       pa.array(kept, pa.string())], ["id", "n_words", "spans", "items", "kept"])
