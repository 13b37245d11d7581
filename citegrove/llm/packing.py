"""Packing by power-of-two decomposition: every document is cut into pieces of binary length, each a sequence of its own."""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.common import chunks, text_buffers, words

KNOWN_WORDS = 500_000
ENCODED_AT_ONCE = 1 << 14
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-ɏ]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose splits never cross white space.

    A word's ids don't depend on its neighbours, so each distinct word is encoded once and looked up by its hash after that.
    Words of Latin letters, digits and signs are split here and encoded by the vocabulary's merges alone; any other word,
    and any text with a special token's mark, goes through the whole tokenizer. At most KNOWN_WORDS words are remembered;
    then the memory starts afresh."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers
        self.path = path
        model = json.load(open(path, encoding="utf-8"))["model"]
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix))
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        # the byte alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b if b in plain else 256 + others.index(b)) for b in range(256)}
        self.forget()

    @cached_property
    def full(self):
        """The whole tokenizer, as large as the merges alone: it is read once the first text or word needs it."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def forget(self):
        self.known = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 20, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.used = 0

    def encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one word after the other, and the number of ids of each word."""
        pieces, counts, odd = [], np.zeros(len(texts), np.int64), {}
        for i, word in enumerate(texts):
            if word.isascii() and word.isalpha():
                pieces.append(word.lower())
                counts[i] = 1
            elif _PLAIN.fullmatch(word):
                found = _PIECES.findall(word.lower())
                pieces += ["".join(map(self.letters.__getitem__, x.encode())) for x in found]
                counts[i] = len(found)
            else:
                odd[i] = self.full.encode(word, add_special_tokens=False).ids
        ids = np.concatenate([np.zeros(0, np.int32), *[
            np.asarray(self.merger.encode_batch_fast([" ".join(pieces[i:i + ENCODED_AT_ONCE])])[0].ids, np.int32)
            for i in range(0, len(pieces), ENCODED_AT_ONCE)]])
        stop = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(stop) != len(pieces) + 1:
            raise ValueError("the vocabulary doesn't mark word ends")
        cut = np.concatenate([[0], np.cumsum(counts)])
        if not odd:
            return ids, np.diff(stop[cut])
        each = [odd[i] if i in odd else ids[stop[cut[i]]:stop[cut[i + 1]]] for i in range(len(texts))]
        return np.concatenate([np.asarray(x, np.int32) for x in each]), np.array([len(x) for x in each])

    def learn(self, keys: np.ndarray, texts: list[str]):
        ids, lengths = self.encode_words(texts)
        n, at = len(self.known), self.used
        while len(self.ids) < at + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.begin) < n + len(keys):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.ids[at:at + len(ids)] = ids
        self.begin[n:n + len(keys)] = at + np.cumsum(lengths) - lengths
        self.length[n:n + len(keys)] = lengths
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.slots = np.insert(self.slots, at, np.arange(n, n + len(keys), dtype=np.int32))
        self.used += len(ids)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of every row."""
        rows = len(offsets) - 1
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        start, end, h, row = words(data, offsets)
        distinct, first, place = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = np.flatnonzero(at < len(self.known))
        new[inside] = self.known[at[inside]] != distinct[inside]
        missing = np.flatnonzero(new)
        if len(missing):
            body, where = data.tobytes(), first[missing]
            self.learn(distinct[missing],
                       [body[s:e].decode("utf-8", "replace") for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)])
        slot = self.slots[np.searchsorted(self.known, distinct)][place]
        length = self.length[slot]
        after = np.cumsum(length)
        ids = self.ids[np.repeat(self.begin[slot] - after + length, length) + np.arange(after[-1] if len(after) else 0)]
        per_row = np.bincount(row, length, rows).astype(np.int64)
        return np.split(ids, np.cumsum(per_row)[:-1])


_tokenizers: dict[str, WordTokenizer] = {}


def token_rows(data: np.ndarray, offsets: np.ndarray, path: str) -> list[np.ndarray]:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    tokenizer = _tokenizers[path]
    found = tokenizer.encode_rows(data, offsets)
    marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    for r in np.unique(np.searchsorted(offsets, marks, "right") - 1).tolist():
        text = data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "replace")
        found[r] = np.asarray(tokenizer.full.encode(text, add_special_tokens=False).ids, np.int32)
    return found


def binary_pieces(n: int, longest: int) -> list[int]:
    """Lengths that sum to n: as many of `longest` as fit, then the powers of two of what is left, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 4096, end_id: int = 2, text: str = "text",
         id_col: str = "doc_id") -> DataFrame:
    """One row per piece: id_col, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset.

    A document's ids, ended by end_id, are cut into pieces of `longest` (a power of two) and of the powers of two of the
    rest. Each piece fills one sequence by itself, so nothing is padded and no sequence crosses documents; sequences of
    one bucket (log2 of the length) have equal lengths, so a batch is made of any of them. A null or empty text has end_id
    alone. Repeated rows are packed each; an empty table gives no rows; other columns are ignored. A task holds a batch of
    rows and remembers a bounded number of words, and no row leaves the task that read it."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                ids_of = token_rows(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], tokenizer_path)
                where, starts, lengths, parts, totals = [], [], [], [], []
                for r, ids in enumerate(ids_of, a):
                    body, at = np.append(ids, end_id).astype("<u4").tobytes(), 0
                    for n in binary_pieces(len(ids) + 1, longest):
                        where.append(r)
                        starts.append(at)
                        lengths.append(n)
                        parts.append(body[4 * at:4 * (at + n)])
                        totals.append(len(ids) + 1)
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(where, pa.int64())), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(parts, pa.binary()), pa.array(totals, pa.int64())],
                    [id_col, "start", "length", "ids", "doc_tokens"])

    cut = docs.select(id_col, text).mapInArrow(
        pieces, f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long")
    return cut.select("*", F.log2(F.col("length")).cast("int").alias("bucket"),
                      F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
