"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

Ranks are exchanged in rounds at growing lengths: positions that start the same short string, then the same longer one, then
the same string of the threshold; a position leaves as soon as its rank is unique or its answer known. Two things keep the
rounds small. Only sampled positions are ranked at first: of every 50-byte string the place of its least hashed 28-byte part,
which is the same place wherever the string stands. And a rank is a 64-bit fingerprint of the string, so that equal ranks are
found by sorting fingerprints, not by shifting every position of every text through a sort."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.common import BASE, BYTE_VALUES, _power, chunks, mix, pack, stored, text_buffers

LAST = np.iinfo(np.int64).max
STATE = "block long, ids binary, offsets binary, cuts binary, body binary, runs binary, done binary"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    n = len(x) - w + 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span:w - span + n])


@dataclass
class Block:
    """Whole documents one after the other. ids order them (no id: last). cuts: the stretches whose bytes are known; the
    others read as zeros. runs: (place, first start, last start) of strings with one sampled place that are still to be
    decided; done: (first start, last start) of strings known to stand in an earlier document."""
    block: int
    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    runs: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int32))
    done: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int32))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of the strings from starts to ends."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * _power(BASE, "up", n), out=total[1:])
        h = (total[ends] - total[starts]) * _power(pow(BASE, -1, 2**64), "down", n)[starts]
        return mix(h ^ (np.asarray(ends) - starts).astype(np.uint64))

    def documents_of(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.offsets, at, "right") - 1]

    def sample(self, length: int, part: int) -> np.ndarray:
        """runs of all strings of `length` bytes within one document."""
        n, w = len(self.data), length - part + 1
        if n < length:
            return self.runs
        size = np.diff(self.offsets)
        from_end = np.repeat(self.offsets[1:], size) - np.arange(n)
        start = np.flatnonzero(from_end >= length)
        every = np.arange(n - part + 1)
        rank = self.hashes(every, every + part) & np.uint64(0xFFFFFFFF00000000) | every.astype(np.uint64)
        place = (sliding_min(rank, w)[start] & np.uint64(0xFFFFFFFF)).astype(np.int32)
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start))[:len(first)] - 1
        return np.column_stack([place[first], start[first], start[last]]).astype(np.int32)

    def row(self, length: int) -> list:
        """As stored: only the bytes of undecided strings."""
        cover = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(cover, self.runs[:, 1], 1)
        np.add.at(cover, self.runs[:, 2] + length, -1)
        known = np.cumsum(cover)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        return [self.block, pack(self.ids), pack(self.offsets), pack(edge.astype(np.int32)),
                zstandard.compress(pack(self.data[known]), 1), pack(self.runs), pack(self.done)]

    @classmethod
    def from_row(cls, block, ids, offsets, cuts, body, runs, done) -> Block:
        offsets = np.frombuffer(offsets, np.int64)
        edge = np.frombuffer(cuts, np.int32).reshape(-1, 2)
        data = np.zeros(offsets[-1], np.uint8)
        mark = np.zeros(offsets[-1] + 1, np.int32)
        mark[edge[:, 0]] += 1
        mark[edge[:, 1]] -= 1
        data[np.cumsum(mark)[:-1] > 0] = np.frombuffer(zstandard.decompress(body), np.uint8)
        return cls(block, np.frombuffer(ids, np.int64), offsets, data, np.frombuffer(runs, np.int32).reshape(-1, 3),
                   np.frombuffer(done, np.int32).reshape(-1, 2))


def read_blocks(batch: pa.RecordBatch):
    columns = [batch.column(i) for i in range(7)]
    for i in range(batch.num_rows):
        yield Block.from_row(*[c[i].as_py() for c in columns])


def blocks_of(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """Documents dealt into blocks of about `size` bytes, each with its identifiers and their nulls."""
    def gather(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).fill_null(LAST).to_numpy()
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets, size):
                part = offsets[a:b + 1] - offsets[a]
                body = zstandard.compress(pack(data[offsets[a]:offsets[b]]), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pack(ids[a:b])], pa.binary()), pa.array([pack(nulls[a:b])], pa.binary()), pa.array([pack(part)], pa.binary()),
                     pa.array([body], pa.binary()), pa.array([int(part[-1])], pa.int64())], ["ids", "nulls", "offsets", "body", "size"])
    rows = docs.select(F.col(id_col).cast("long"), text).mapInArrow(gather, "ids binary, nulls binary, offsets binary, body binary, size long")
    return stored(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")


def as_state(blocks: DataFrame) -> DataFrame:
    """Whole blocks in the form of STATE: one stretch that covers them, no runs yet."""
    def whole(batches):
        for batch in batches:
            cut = [pack(np.array([0, n] if n else [], np.int32)) for n in batch.column(4).to_pylist()]
            none = pa.array([b""] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cut, pa.binary()), batch.column(3), none, none],
                                             ["block", "ids", "offsets", "cuts", "body", "runs", "done"])
    return blocks.select("block", "ids", "offsets", "body", "size").mapInArrow(whole, STATE)


def ranked(b: Block, starts: np.ndarray, ends: np.ndarray):
    """Distinct fingerprints of these strings (sorted), the one of each string, and the least and last document of each."""
    h = b.hashes(starts, ends)
    distinct, place = np.unique(h, return_inverse=True)
    of = b.documents_of(starts)
    least, most = np.full(len(distinct), LAST), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, place, of)
    np.maximum.at(most, place, of)
    return distinct, place, of, least, most


def exchange(state: DataFrame, strings, bits: int, earlier: bool) -> DataFrame:
    """(block, found): for the distinct fingerprints of each block's strings, in sorted order, a bit: whether the string is in
    another document too, or (earlier) in a document of smaller id than the least one of this block.

    Fingerprints are dealt by their leading bits. A block sends each of its fingerprints once, so that a string that is
    everywhere counts once a block. For the first question 32 bits more are enough: a chance hit only keeps a string longer."""
    def send(batches):
        for batch in batches:
            for b in read_blocks(batch):
                distinct, _, _, least, most = ranked(b, *strings(b))
                cut = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(cut))
                keys = distinct if earlier else (distinct >> np.uint64(32 - bits)).astype(np.uint32)
                docs = least if earlier else np.where(least != most, 1, 0).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.block] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array([pack(keys[cut[i]:cut[i + 1]]) for i in used], pa.binary()),
                     pa.array([pack(docs[cut[i]:cut[i + 1]]) for i in used], pa.binary())], ["block", "bucket", "keys", "docs"])

    def compare(rows: pa.Table) -> pa.Table:
        kind, doc_kind = (np.uint64, np.int64) if earlier else (np.uint32, np.uint8)
        parts = [np.frombuffer(x, kind) for x in rows["keys"].to_pylist()]
        doc = np.frombuffer(b"".join(rows["docs"].to_pylist()), doc_kind)
        distinct, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        if earlier:
            least = np.full(len(distinct), LAST)
            np.minimum.at(least, place, doc)
            hit = doc > least[place]
        else:
            several = count > 1
            several[place[doc > 0]] = True
            hit = several[place]
        stop = np.cumsum([len(x) for x in parts])
        found = [pack(np.packbits(x)) for x in np.split(hit, stop[:-1])]
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "n": pa.array([len(x) for x in parts], pa.int32()), "bits": pa.array(found, pa.binary())})

    sent = state.mapInArrow(send, "block long, bucket int, keys binary, docs binary")
    answers = sent.groupBy("bucket").applyInArrow(compare, "block long, bucket int, n int, bits binary")
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias("found"))


def unpacked(found) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in found or []]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def advance(state: DataFrame, strings, bits: int, earlier: bool, decide, length: int, name: str) -> DataFrame:
    """One round: exchanges the strings' ranks and lets `decide` change each block by the answers; blocks without anything
    left and known are dropped."""
    def step(batches):
        for batch in batches:
            found, rows = batch.column(7), []
            for i, b in enumerate(read_blocks(batch)):
                distinct, place, of, least, _ = ranked(b, *strings(b))
                hit = unpacked(found[i].as_py())[place]
                decide(b, hit | (of > least[place]) if earlier else hit)
                if len(b.runs) or len(b.done):
                    rows.append(b.row(length))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if j else pa.int64()) for j, c in enumerate(columns)],
                                             ["block", "ids", "offsets", "cuts", "body", "runs", "done"])

    joined = state.join(exchange(state, strings, bits, earlier), "block")
    return stored(joined.mapInArrow(step, STATE), name)


def repeated_strings(docs: DataFrame, length: int = 50, part: int = 28, id_col: str = "doc_id", text: str = "text",
                     block_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(blocks, spans): the documents in blocks, and for each block the byte ranges that strings of `length` bytes cover which
    also start in a document with a smaller id."""
    if not 0 < part <= length:
        raise ValueError("0 < part <= length")
    blocks = blocks_of(docs, id_col, text, block_bytes)
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = min(24, max(6, int(total // (4 << 20)).bit_length()))

    def sampled(b: Block):
        b.runs = b.sample(length, part)
        return places(b)

    def places(b: Block):
        return b.runs[:, 0], b.runs[:, 0] + part

    def phrases(b: Block):
        return b.runs[:, 1], b.runs[:, 2] + length

    def windows(b: Block):
        n = b.runs[:, 2] - b.runs[:, 1] + 1
        start = np.repeat(b.runs[:, 1] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return start, start + length

    def keep(b: Block, hit: np.ndarray):
        b.runs = b.runs[hit]

    def settle(b: Block, hit: np.ndarray):
        b.done, b.runs = np.concatenate([b.done, b.runs[hit][:, 1:]]), b.runs[~hit]

    def finish(b: Block, hit: np.ndarray):
        start = windows(b)[0][hit].astype(np.int32)
        b.done, b.runs = np.concatenate([b.done, np.column_stack([start, start])]), b.runs[:0]

    state = advance(as_state(blocks), sampled, bits, False, keep, length, "ranks-sampled")
    state = advance(state, phrases, bits, True, settle, length, "ranks-phrases")
    kept = state.filter(F.octet_length("runs") > 0)
    last = advance(advance(kept, places, bits, False, keep, length, "ranks-open"), windows, bits, True, finish, length, "ranks-whole")
    known = state.select("block", "done").filter(F.octet_length("done") > 0).unionByName(last.select("block", "done"))

    def merge(batches):
        for batch in batches:
            spans = []
            for parts in batch.column(1).to_pylist():
                edge = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2)
                edge = edge[np.argsort(edge[:, 0], kind="stable")]
                stop = np.maximum.accumulate(edge[:, 1] + length)
                new = np.append(True, edge[1:, 0] > stop[:-1]) if len(edge) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                spans.append(pack(np.column_stack([edge[at, 0], stop[np.append(at[1:], len(edge)) - 1]]) if len(edge) else edge))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.binary())], ["block", "spans"])

    spans = known.groupBy("block").agg(F.collect_list("done").alias("done")).mapInArrow(merge, "block long, spans binary")
    return blocks, stored(spans, "spans")


def at_documents(edge: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ranges, cut where one document ends and the next one starts."""
    inner = np.unique(offsets)
    inside = np.searchsorted(edge[:, 0], inner, "left") - 1
    cut = inner[(inside >= 0) & (inner < edge[inside, 1])] if len(edge) else inner[:0]
    return np.column_stack([np.sort(np.append(edge[:, 0], cut)), np.sort(np.append(edge[:, 1], cut))])


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text: str = "text", part: int = 28, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, spans (start and end byte of each maximal removed range), kept (the
    bytes that stay, in order).

    A byte is removed if a string of `length` bytes covers it that also starts in a document with a smaller id; matches never
    cross documents and are judged on the input. A null text counts as empty. A row without id comes after all others, and
    rows of one id (repeated rows) never remove each other. An empty table gives no rows; other columns are ignored. Memory is
    bounded by a block (a longer document is a block by itself) and by a bucket of fingerprints."""
    blocks, spans = repeated_strings(docs, length, part, id_col, text, block_bytes)

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, nulls, offsets, body, span = (batch.column(j)[i].as_py() for j in range(5))
                ids, nulls, offsets = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool), np.frombuffer(offsets, np.int64)
                body = zstandard.decompress(body)
                edge = at_documents(np.frombuffer(span or b"", np.int32).reshape(-1, 2), offsets)
                low = np.searchsorted(edge[:, 0], offsets)
                ranges, kept, removed = [], [], []
                for d in range(len(ids)):
                    at, parts, own = int(offsets[d]), [], edge[low[d]:low[d + 1]]
                    for s, e in own.tolist():
                        parts.append(body[at:s])
                        at = e
                    parts.append(body[at:int(offsets[d + 1])])
                    kept.append(b"".join(parts))
                    ranges.append([{"start": s - int(offsets[d]), "end": e - int(offsets[d])} for s, e in own.tolist()])
                    removed.append(int((own[:, 1] - own[:, 0]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=nulls), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                     pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    [id_col, "n_bytes", "n_removed", "spans", "kept"])

    joined = blocks.join(spans, "block", "left").select("ids", "nulls", "offsets", "body", "spans")
    return joined.mapInArrow(cut, f"`{id_col}` long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary")
