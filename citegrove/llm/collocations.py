"""Phrase collocations by Rabin-Karp fingerprints: n-grams are counted as fingerprints with a pointer to an occurrence, and only
phrases that turn out frequent are read back from the texts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrove.llm.common import BASE, BYTE_VALUES, _power, chunks, mix, pack, stored, text_buffers

CHECK_BASE = 0xD1342543DE82EF95
BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 16 << 20
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 10
_PLAIN[9] = 32


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = (data != 32) & (data != 10)
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def text_blocks(docs: DataFrame, text: str, lang: str, size: int) -> DataFrame:
    """(block, lang, n_words, n_bytes, body): the texts of one language, lower-cased (A-Z), with line feeds between pieces, in blocks
    of about `size` bytes; longer texts are cut between pieces."""
    def cut(name: str, parts: list[bytes]):
        body = b"\n".join(parts)
        at = 0
        while at < len(body):
            end = len(body)
            if end - at > size:
                end = body.rfind(b"\n", at, at + size) + 1 or body.find(b"\n", at + size) + 1 or end
            own = body[at:end]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.string()), pa.array([len(word_edges(np.frombuffer(own, np.uint8))[0])], pa.int64()), pa.array([len(own)], pa.int64()),
                 pa.array([zstandard.compress(own, 3)], pa.binary())], ["lang", "n_words", "n_bytes", "body"])
            at = end

    def gather(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in chunks(offsets):
                plain = _PLAIN[data[offsets[a]:offsets[b]]].tobytes()
                for i in range(a, b):
                    name = names[i]
                    held.setdefault(name, []).append(plain[offsets[i] - offsets[a]:offsets[i + 1] - offsets[a]])
                    sizes[name] = sizes.get(name, 0) + int(offsets[i + 1] - offsets[i]) + 1
                    if sizes[name] >= size:
                        yield from cut(name, held.pop(name))
                        del sizes[name]
                if sum(sizes.values()) >= 4 * size:
                    for name in list(held):
                        yield from cut(name, held.pop(name))
                    sizes.clear()
        for name in list(held):
            yield from cut(name, held.pop(name))

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(gather, "lang string, n_words long, n_bytes long, body binary")
    return stored(found.withColumn("block", F.monotonically_increasing_id()), "phrase-blocks")


def prefix_hashes(values: np.ndarray, base: int, name: str) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, f"{name} up", len(values)), out=total[1:])
    return total


def from_prefixes(total: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, name: str) -> np.ndarray:
    return (total[end] - total[start]) * _power(pow(base, -1, 2**64), f"{name} down", len(total))[start]


def word_values(words: pa.Array, seed: int, base: int, name: str) -> np.ndarray:
    """A value for each word: the polynomial of its bytes, mixed with its length and the language's seed."""
    data, offsets = text_buffers(words)
    out = np.empty(len(words), np.uint64)
    for a, b in chunks(offsets):
        at = offsets[a:b + 1] - offsets[a]
        total = prefix_hashes(BYTE_VALUES[data[offsets[a]:offsets[b]]], base, name)
        out[a:b] = mix(from_prefixes(total, at[:-1], at[1:], base, name) ^ np.diff(at).astype(np.uint64) ^ np.uint64(seed))
    return out


@dataclass
class Grams:
    """n-grams of one length in a block: the group of the gram at each place (-1: none), and first place and count of each group."""
    group: np.ndarray
    first: np.ndarray
    count: np.ndarray


class Block:
    """Words of one block as exact numbers, and the fingerprints of word sequences by prefix polynomials."""

    def __init__(self, lang: str, body: bytes):
        data = np.frombuffer(zstandard.decompress(body), np.uint8)
        self.lang = lang
        self.start, end = word_edges(data)
        self.piece = np.searchsorted(np.flatnonzero(data == 10), self.start).astype(np.int32)
        offsets = np.append(0, np.cumsum(end - self.start))
        letters = pa.py_buffer(data[(data != 32) & (data != 10)].tobytes())
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(end), [None, pa.py_buffer(pack(offsets)), letters]).dictionary_encode()
        self.words, self.ids = words.dictionary, words.indices.to_numpy()
        self.start = self.start.astype(np.uint32)

    @cached_property
    def prefixes(self) -> list[np.ndarray]:
        seed = xxhash.xxh64_intdigest(self.lang)
        return [prefix_hashes(word_values(self.words, seed, base, name)[self.ids], base, name) for base, name in ((BASE, "fp"), (CHECK_BASE, "check"))]

    def fingerprints(self, first: np.ndarray, n, check: bool = False) -> np.ndarray:
        """Of the n words from each of these places on."""
        base, name = (CHECK_BASE, "check") if check else (BASE, "fp")
        return mix(from_prefixes(self.prefixes[check], first, first + n, base, name) + np.asarray(n).astype(np.uint64))

    def single(self) -> Grams:
        count = np.bincount(self.ids, minlength=len(self.words))
        first = np.empty(len(self.words), np.int32)
        first[self.ids[::-1]] = np.arange(len(self.ids), dtype=np.int32)[::-1]
        return Grams(self.ids, first, count)

    def longer(self, n: int, before: Grams, use: np.ndarray | None = None) -> Grams:
        """The n-grams of all places (or of those in use), from the groups of (n-1)-grams: exact, by numbers."""
        size = max(0, len(self.ids) - n + 1)
        fits = self.piece[:size] == self.piece[n - 1:][:size]
        place = np.flatnonzero(fits if use is None else fits & use[:size]).astype(np.int32)
        prev, last = before.group[place], self.ids[place + n - 1]
        group = np.full(len(self.ids), -1, np.int32)
        if not len(place):
            return Grams(group, place, place)
        if len(self.ids) < 1 << 21:
            key = np.sort((prev.astype(np.uint64) << np.uint64(42)) | (last.astype(np.uint64) << np.uint64(21)) | np.arange(len(place), dtype=np.uint64))
            order = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
            key >>= np.uint64(21)
            new = np.append(True, key[1:] != key[:-1])
        else:
            order = np.lexsort((last, prev))
            new = np.append(True, (prev[order][1:] != prev[order][:-1]) | (last[order][1:] != last[order][:-1]))
        at = np.flatnonzero(new)
        group[place[order]] = np.cumsum(new) - 1
        return Grams(group, place[order[at]], np.diff(np.append(at, len(order))))


def packed(values: np.ndarray, deltas: bool = False) -> bytes:
    """Numbers as compressed bytes, equal places of all numbers together; sorted ones as differences."""
    if deltas:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.compress(pack(values.view(np.uint8).reshape(len(values), -1).T), 1)


def unpacked(body: bytes, kind, deltas: bool = False) -> np.ndarray:
    width = np.dtype(kind).itemsize
    values = np.ascontiguousarray(np.frombuffer(zstandard.decompress(body), np.uint8).reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if deltas else values


def by_bucket(h: np.ndarray, bits: int):
    """(bucket, slice) of sorted fingerprints, by their leading bits."""
    cut = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for i in np.flatnonzero(np.diff(cut)):
        yield int(i), slice(cut[i], cut[i + 1])


def short_entries(block: Block) -> tuple[np.ndarray, np.ndarray, Grams, Grams]:
    """Words and pairs of a block: their fingerprints (words first), the order that sorts these, and the grams."""
    one = block.single()
    two = block.longer(2, one)
    h = np.concatenate([block.fingerprints(one.first, 1), block.fingerprints(two.first, 2)])
    return h, np.argsort(h), one, two


def frequent_short(blocks: DataFrame, least: int, bits: int) -> DataFrame:
    """(block, bucket, n, bits): for the words and pairs of each block, in order of fingerprint, whether they can occur `least`
    times in all. Only 32 bits beyond the bucket travel: a chance hit keeps a gram that the next round then counts exactly."""
    def send(batches):
        for batch in batches:
            for number, lang, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h, order, one, two = short_entries(Block(lang, body))
                h = h[order]
                count = np.minimum(np.concatenate([one.count, two.count])[order], least).astype(np.uint32)
                rows = [(number, bucket, packed((h[at] >> np.uint64(32 - bits)).astype(np.uint32), True), packed(count[at])) for bucket, at in by_bucket(h, bits)]
                yield pa.RecordBatch.from_pylist([dict(zip(("block", "bucket", "keys", "counts"), r, strict=True)) for r in rows],
                                                 pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def merge(rows: pa.Table) -> pa.Table:
        keys = [unpacked(x, np.uint32, True) for x in rows["keys"].to_pylist()]
        counts = np.concatenate([unpacked(x, np.uint32) for x in rows["counts"].to_pylist()])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        enough = (np.bincount(place, weights=counts) >= least)[place]
        sizes = [len(k) for k in keys]
        found = [pack(np.packbits(x)) for x in np.split(enough, np.cumsum(sizes)[:-1])]
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "n": pa.array(sizes, pa.int32()), "bits": pa.array(found, pa.binary())})

    sent = blocks.select("block", "lang", "body").mapInArrow(send, "block long, bucket int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(merge, "block long, bucket int, n int, bits binary")


ENTRY = [("bucket", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()),
         ("counts", pa.binary()), ("places", pa.binary())]


def frequent_grams(blocks: DataFrame, answers: DataFrame, most: int, least: int, bits: int) -> DataFrame:
    """(lang, n, fingerprint, check, f, block, place): all n-grams of up to `most` words with `least` or more occurrences, and the place
    (a byte of a block) of one. Longer grams are counted where all their pairs can be frequent. Grams are told apart by 64 + 32 bits."""
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in ENTRY})
        number, lang, body = left["block"][0].as_py(), left["lang"][0].as_py(), left["body"][0].as_py()
        block = Block(lang, body)
        h, order, one, two = short_entries(block)
        parts = sorted(zip(right["bucket"].to_pylist(), right["n"].to_pylist(), right["bits"].to_pylist(), strict=True))
        known = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in parts]
        kept = np.zeros(len(h), bool)
        kept[order] = np.concatenate(known).astype(bool) if known else False
        levels = [(1, one, kept[:len(one.first)]), (2, two, kept[len(one.first):])]
        pair = np.append(levels[1][2], False)[two.group]
        before = two
        for n in range(3, most + 1):
            use = pair.copy()
            for i in range(1, n - 1):
                use[:-i] &= pair[i:]
                use[-i:] = False
            before = block.longer(n, before, use)
            levels.append((n, before, np.ones(len(before.first), bool)))
        rows = []
        for n, grams, chosen in levels[:most]:
            first, count = grams.first[chosen], grams.count[chosen]
            key = block.fingerprints(first, n)
            by = np.argsort(key)
            key, first, count = key[by], first[by], count[by]
            check = (block.fingerprints(first, n, True) >> np.uint64(32)).astype(np.uint32)
            rows += [(bucket, lang, n, number, packed(key[at], True), pack(check[at]), packed(count[at].astype(np.uint32)),
                      packed(block.start[first[at]])) for bucket, at in by_bucket(key, bits)]
        columns = list(zip(*rows, strict=True)) or [()] * len(ENTRY)
        return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, ENTRY, strict=True)], names=[name for name, _ in ENTRY])

    def merge(rows: pa.Table) -> pa.Table:
        keys = [unpacked(x, np.uint64, True) for x in rows["keys"].to_pylist()]
        of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key = np.concatenate(keys)
        check = np.frombuffer(b"".join(rows["checks"].to_pylist()), np.uint32)
        place = np.concatenate([unpacked(x, np.uint32) for x in rows["places"].to_pylist()])
        count = np.concatenate([unpacked(x, np.uint32) for x in rows["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if (same & (check[order][1:] != check[order][:-1])).any():  # two phrases of one fingerprint
            order = np.lexsort((check, key))
            same = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
        at = np.flatnonzero(np.append(True, ~same))
        total = np.add.reduceat(count[order], at)
        size = np.diff(np.append(at, len(order)))
        # the occurrence of a holder picked by the fingerprint: no block is asked for more phrases than others
        at += (key[order[at]] % size.astype(np.uint64)).astype(np.int64)
        at, total = order[at[total >= least]], total[total >= least]
        row = of[at]
        return pa.table({"lang": rows["lang"].take(pa.array(row)), "n": rows["n"].take(pa.array(row)), "fingerprint": pa.array(key[at].view(np.int64)),
                         "check": pa.array(check[at].astype(np.int64)), "f": pa.array(total), "block": rows["block"].take(pa.array(row)),
                         "place": pa.array(place[at].astype(np.int64))})

    bodies = blocks.select("block", "lang", "body").groupBy("block")
    schema = "bucket int, lang string, n int, block long, keys binary, checks binary, counts binary, places binary"
    sent = bodies.cogroup(answers.groupBy("block")).applyInArrow(send, schema)
    return sent.groupBy("bucket").applyInArrow(merge, "lang string, n int, fingerprint long, check long, f long, block long, place long")


def phrases_of(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, n, phrase, f): the frequent grams read from their places in the texts, where both fingerprints are verified."""
    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        block = Block(left["lang"][0].as_py(), left["body"][0].as_py()) if left.num_rows and right.num_rows else None
        for n in np.unique(right["n"].to_numpy()).tolist() if block else []:
            rows = right.filter(pc.equal(right["n"], n))
            first = np.searchsorted(block.start, rows["place"].to_numpy())
            h, check = block.fingerprints(first, n), block.fingerprints(first, n, True) >> np.uint64(32)
            if (h.view(np.int64) != rows["fingerprint"].to_numpy()).any() or (check.astype(np.int64) != rows["check"].to_numpy()).any():
                raise ValueError("a pointer does not lead to the phrase of its fingerprint")
            words = [block.words.take(pa.array(block.ids[first + i])) for i in range(n)]
            joined = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
            out.append(pa.table({"lang": rows["lang"], "n": rows["n"], "phrase": joined.cast(pa.string()), "f": rows["f"]}))
        return pa.concat_tables(out) if out else pa.table({"lang": pa.array([], pa.string()), "n": pa.array([], pa.int32()),
                                                            "phrase": pa.array([], pa.string()), "f": pa.array([], pa.int64())})

    bodies = blocks.select("block", "lang", "body").groupBy("block")
    return bodies.cogroup(frequent.groupBy("block")).applyInArrow(read, "lang string, n int, phrase string, f long")


def scored(grams: DataFrame) -> DataFrame:
    """(lang, phrase, n, a, l, r, score) of every phrase of two or more words, by its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = grams.filter("n > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select(
        "lang", "phrase", "n", F.col("f").alias("a"), "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("right"))
    part = lambda side, count: grams.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
    known = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    known = known.select("lang", "phrase", "n", "a", "k", "l", "r", (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(38,0)")).alias("over"),
                         (wide("l") * wide("r")).alias("under")).withColumn("score", F.expr("over div under"))
    best = known.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    return best.select("lang", "phrase", "cut.n", "cut.a", "cut.l", "cut.r", "cut.score")


def without_contained(found: DataFrame, share: int) -> DataFrame:
    """Phrases that do not lie within a longer one with at least `share` percent of their occurrences."""
    words = F.split("phrase", " ")
    inner = found.filter("n > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n") - 1))).withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)))
    held = inner.select("lang", F.array_join(F.slice(words, F.col("i"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return found.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, text: str = "text",
                 lang: str = "lang", block_bytes: int = BLOCK_BYTES, parts: int = 256) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to most_words words of each language.

    Texts are lower-cased (A-Z) and cut into pieces at . , ; : ! ? and line breaks, pieces into words at blanks and tabs. Phrases with
    a >= least occurrences within pieces are scored by floor(10^6 a^2 / (l r)) of their lowest-scoring cut in two (ties: the first
    cut), l and r being the occurrences of the parts; n is the number of words of the language. Phrases inside a longer one with at
    least `share` percent of their occurrences are dropped. Order: score, then a (both falling), then phrase by bytes.

    A null text is empty; a null language is "und". Repeated rows count again. Languages without such a phrase, and empty tables, give
    no rows; other columns are ignored. Blocks of 12 MB are counted by themselves, so that a word that is everywhere travels once a block;
    a longer text is cut between pieces (a piece is never cut). Languages of any number are told apart. `parts`: a language's ranking is
    made of so many first."""
    if most_words < 2 or least < 1:
        raise ValueError("most_words is 2 or more, least 1 or more")
    blocks = text_blocks(docs, text, lang, block_bytes)
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = min(18, max(4, int(size // BUCKET_BYTES).bit_length()))
    answers = stored(frequent_short(blocks, least, bits), "phrase-answers")
    frequent = stored(frequent_grams(blocks, answers, most_words, least, bits), "phrase-frequent")
    grams = stored(phrases_of(blocks, frequent), "phrases")
    found = without_contained(scored(grams), share).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "part"], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("words"))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
