"""Jaccard self-join of word shingles by chosen paths: sets that pick the same shared tokens meet in a bucket."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.common import chunks, grams, group_starts, mix, pack, stored, text_buffers, whole_groups, words
from citegrove.llm.components import components

BINS, LEVELS = 64, 3
PICK = "array<struct<run:int,token:bigint>>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row), sorted by row and shingle without repetition. Words are split at ASCII white space, without regard to
    the case of A-Z; a row of fewer than k words has the run of all its words as its only shingle."""
    _, _, word, row = words(data, offsets)
    h, first = grams(word, row, k)
    of = row[first]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        starts = np.cumsum(counts) - counts
        whole = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            whole[has] = mix(whole[has] * np.uint64(31) + word[starts[short[has]] + i])
        h, of = np.concatenate([h, whole]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]


def _list_of_picks(picks: list[tuple[int, np.ndarray, np.ndarray]], rows: int) -> pa.Array:
    run = np.concatenate([np.full(len(t), r, np.int32) for r, t, _ in picks])
    token = np.concatenate([t for _, t, _ in picks])
    row = np.concatenate([x for _, _, x in picks])
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(run[order]), pa.array(token[order].view(np.int64))], ["run", "token"])
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def picked(h: np.ndarray, row: np.ndarray, n: np.ndarray, similarity: float, runs: int, level: int) -> pa.Array:
    """The tokens that each set picks at a level, by run. A token is picked where its hash for the run and level is below
    1 / (similarity * n), so every set picks 1 / similarity tokens on average, and similar sets the same ones."""
    limit = np.minimum(2.0**32 / (similarity * np.maximum(n, 1)), 2.0**32 - 1).astype(np.uint64)[row]
    picks = []
    for j in range(0, runs, 2):
        x = mix(h + np.uint64(0x9E3779B97F4A7C15 * (level * 1009 + j + 1) % 2**64))
        for i, y in ((j, x >> np.uint64(32)), (j + 1, x & np.uint64(0xFFFFFFFF))):
            if i < runs:
                at = np.flatnonzero(y <= limit)
                picks.append((i, h[at], row[at]))
    return _list_of_picks(picks, len(n))


def picks_of(docs: DataFrame, k: int, similarity: float, runs: int, level: int, id_col: str, text: str) -> DataFrame:
    """(id, run, token): what the sets of these documents pick at a level."""
    def pick(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                h, row = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), picked(h, row, np.bincount(row, minlength=b - a), similarity, runs, level)], ["id", "picks"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(pick, f"id long, picks {PICK}")
    return rows.select("id", F.explode("picks").alias("p")).select("id", "p.run", "p.token").distinct()


def signatures(docs: DataFrame, k: int, similarity: float, runs: int, id_col: str, text: str) -> DataFrame:
    """One row per document with words: id, n (distinct shingles), two hashes of the whole set, a sketch (the least hash in
    each of BINS bins) and the tokens picked at the first level."""
    def sign(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                rows = b - a
                h, row = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k)
                n = np.bincount(row, minlength=rows)
                starts = np.cumsum(n) - n
                full = np.flatnonzero(n)
                one, two = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                if len(full):
                    one[full] = np.add.reduceat(mix(h ^ np.uint64(0x51)), starts[full])
                    two[full] = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0xA7)), starts[full])
                sketch = np.zeros((rows, BINS), np.uint16)
                bin_of = (h >> np.uint64(58)).astype(np.int64)
                least = np.ones(len(h), bool)
                least[1:] = (bin_of[1:] != bin_of[:-1]) | (row[1:] != row[:-1])
                sketch[row[least], bin_of[least]] = (h[least] >> np.uint64(40)).astype(np.uint16) | np.uint16(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.array([pack(x) for x in sketch], pa.binary()), picked(h, row, n, similarity, runs, 0)],
                    ["id", "n", "one", "two", "sketch", "picks"]).filter(pa.array(n > 0))

    kept = docs.select(F.col(id_col).cast("long").alias("id"), text).filter("id IS NOT NULL")
    return kept.mapInArrow(sign, f"id long, n long, one long, two long, sketch binary, picks {PICK}")


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, over the bins that either uses."""
    return ((a == b) & (a > 0)).sum(-1) / np.maximum(((a > 0) | (b > 0)).sum(-1), 1)


def _connect(labels: np.ndarray, i: int, near: np.ndarray) -> np.ndarray:
    """Of the rows `near` to row i, one of each group that isn't connected with it yet; connects them."""
    groups, first = np.unique(labels[near], return_index=True)
    new = groups != labels[i]
    labels[np.isin(labels, groups[new])] = labels[i]
    return near[first[new]]


def bucket_links(ids: np.ndarray, sketch: np.ndarray, link: float, done: float) -> list[tuple[int, int]]:
    """Links that connect all similar members of one bucket, fewer than it has members. A leader is compared with all others
    and connected where the estimate reaches `link`; those that reach `done` need no comparison of their own, as whoever is
    similar to them is connected too."""
    found, left, labels = [], np.arange(len(ids)), np.arange(len(ids))
    while len(left) > 1:
        e = alike(sketch[left[0]], sketch[left[1:]])
        found += [(int(ids[left[0]]), int(ids[i])) for i in _connect(labels, left[0], left[1:][e >= link])]
        left = left[1:][e < done]
    return found


def candidate_links(buckets: DataFrame, link: float, done: float) -> DataFrame:
    """(a, b) from rows (bucket, part, id, sketch, side): small buckets are compared pair by pair, in larger ones by leaders;
    parts with two sides compare one side with the other."""
    keys = ["bucket", "part"]

    def compare(batches):
        for t in whole_groups(batches, keys):
            ids, starts = t["id"].to_numpy(), group_starts(t, keys)
            sides = t["side"].to_numpy()
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(-1, BINS)
            sizes, links = np.diff(starts), []
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = sizes[group] <= 12
            for d in range(1, 12):
                i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if len(group) > d else np.zeros(0, np.int64)
                if not len(i):
                    break
                i = i[alike(sketch[i], sketch[i + d]) >= link]
                links += zip(ids[i].tolist(), ids[i + d].tolist(), strict=True)
            for g in np.flatnonzero(sizes > 12).tolist():
                s, e = starts[g], starts[g + 1]
                if sides[s] == 2:
                    links += bucket_links(ids[s:e], sketch[s:e], link, done)
                else:
                    other, labels = np.flatnonzero(sides[s:e] == 1), np.arange(e - s)
                    for i in np.flatnonzero(sides[s:e] == 0).tolist():
                        near = other[alike(sketch[s + i], sketch[s + other]) >= link]
                        links += [(int(ids[s + i]), int(ids[s + x])) for x in _connect(labels, i, near)]
            a, b = (np.array(links, np.int64).reshape(-1, 2)[:, i] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = buckets.repartition(*keys).sortWithinPartitions(*keys, "id")
    return dealt.select(*keys, "id", "sketch", "side").mapInArrow(compare, "a long, b long").filter("a <> b").distinct()


def in_parts(rows: DataFrame, size: str, most: int, by: list[str]) -> DataFrame:
    """Adds part and side: a group of more than `most` is cut into blocks by hashed id, and each pair of blocks is a part that
    holds both (sides 0 and 1; side 2: a block by itself). So no part holds more than two blocks, and every two members
    meet as different sides, or in side 2, just once."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col(size) / most))
    block = F.pmod(F.xxhash64("id", *by), n)
    other = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    out = rows.withColumn("_n", n).withColumn("_block", block).withColumn("_other", other)
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    return out.withColumn("part", low * F.col("_n") + high).withColumn(
        "side", F.when(low == high, 2).otherwise((F.col("_block") == high).cast("int"))).drop("_n", "_block", "_other")


def paths(signed: DataFrame, most: int, picks_at) -> DataFrame:
    """(bucket, part, side, id) of all buckets of two or more sets. Level by level, sets with the same path of picked tokens
    form a bucket; one of more than `most` is split by the tokens of the next level, and after the last level into blocks.
    picks_at(ids, level): (id, run, token) of these sets; they are worked out for the sets of split buckets only."""
    def bucket(path, run, token):
        return F.xxhash64(path, F.col(run), F.col(token))

    level = signed.select("id", F.explode("picks").alias("p")).select("id", F.col("p.run").alias("run"), bucket(F.lit(0), "p.run", "p.token").alias("bucket"))
    ready = None
    for depth in range(LEVELS):
        sizes = level.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        level = stored(level.join(sizes, "bucket"), "paths")
        last = depth == LEVELS - 1
        now = in_parts(level if last else level.filter(F.col("size") <= most), "size", most, ["bucket"]).select("bucket", "part", "side", "id")
        ready = now if ready is None else ready.unionByName(now)
        if last or not level.filter(F.col("size") > most).take(1):
            return ready
        large = stored(level.filter(F.col("size") > most).select("id", "run", F.col("bucket").alias("path")), "split-paths")
        level = large.join(picks_at(large.select("id").distinct(), depth + 1), ["id", "run"]).select("id", "run", bucket(F.col("path"), "run", "token").alias("bucket"))
    return ready


def runs_for(recall: float, similarity: float) -> int:
    """Runs until a pair at the threshold is met with the wanted probability: one run meets it if a shared token is picked, of
    which there is one on average at least; a bucket split on all levels needs that LEVELS times."""
    once = (1 - math.exp(-1)) ** LEVELS
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def exact_links(members: DataFrame, docs: DataFrame, k: int, similarity: float, id_col: str, text: str, most_shingles: int) -> DataFrame:
    """(id, links, label): members (id, component, n, copies) of a candidate component are compared exactly, all with all, in
    parts of bounded size (a document counts as 512 shingles at least). links counts similar rows with their copies; label is the least similar id, through others too."""
    total = members.groupBy("component").agg(F.sum(F.greatest("n", F.lit(512).cast("long"))).alias("size"))
    parts = in_parts(members.join(total, "component"), "size", most_shingles, ["component"])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    one = texts.join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by("_text", "_h").alias("_text"))
    rows = one.join(parts, "id").select("component", "part", "side", "id", "copies", "_text")
    keys = ["component", "part"]
    share = Fraction(str(similarity))

    def measure(batches):
        for t in whole_groups(batches, keys, 1_000):
            data, offsets = text_buffers(t["_text"])
            ids, side, copies = (t[c].to_numpy() for c in ("id", "side", "copies"))
            sets = [(h, row + a) for a, b in chunks(offsets) for h, row in [shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k)]]
            h, row = (np.concatenate(x) for x in zip(*sets, strict=True))
            n = np.bincount(row, minlength=len(ids))
            stops = np.cumsum(n)
            links, label = np.zeros(len(ids), np.int64), ids.copy()
            starts = group_starts(t, keys)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = slice(stops[s] - n[s], stops[e - 1])
                distinct, column = np.unique(h[part], return_inverse=True)
                both = np.zeros((e - s, e - s), np.float32)
                step = max(1, (1 << 21) // (e - s))
                for c in range(0, len(distinct), step):
                    inside = (column >= c) & (column < c + step)
                    x = np.zeros((e - s, min(step, len(distinct) - c)), np.float32)
                    x[row[part][inside] - s, column[inside] - c] = 1
                    both += x @ x.T
                both = both.astype(np.int64)
                near = both * share.denominator >= (n[s:e, None] + n[None, s:e] - both) * share.numerator
                near &= (side[s:e, None] != side[None, s:e]) | (side[s] == 2)
                np.fill_diagonal(near, False)
                links[s:e] = near @ copies[s:e]
                now = ids[s:e].copy()
                while True:
                    least = np.where(near, now[None, :], np.iinfo(np.int64).max).min(1)
                    next_label = np.minimum(now, least)
                    if (next_label == now).all():
                        break
                    now = next_label
                label[s:e] = now
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(label)], ["id", "links", "label"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInArrow(measure, "id long, links long, label long")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.999, bucket: int = 4096,
                    most_shingles: int = 1 << 18, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id_col, class_id (the least id that it is linked with, through others too), n_links (other
    documents whose set of k-word shingles has a Jaccard similarity of at least `similarity`), copies (documents of an equal
    set, itself too), representative (the least of these).

    Documents of equal sets are one set first. Chosen paths then find buckets of similar sets, in as many runs as the target
    recall asks for; sketches join the sets of a bucket into candidate components, in which all links are counted exactly.
    Documents without words (null and empty texts too) and rows without id have no links; a repeated row counts once; of
    different texts of one id each has a row; an empty table gives no rows; other columns are ignored."""
    runs = runs_for(recall, similarity)
    signed = stored(signatures(docs, k, similarity, runs, id_col, text), "signatures")
    same = ["n", "one", "two"]
    classes = signed.select("id", *same).distinct().groupBy(*same).agg(F.min("id").alias("representative"), F.count("*").alias("copies"))
    classes = stored(classes, "set-classes")
    first = classes.select(F.col("representative").alias("id"), *same)

    def of_sets(column: str) -> DataFrame:
        return signed.select("id", *same, column).join(first, ["id", *same], "left_semi").dropDuplicates(["id", *same]).select("id", column)

    def picks_at(ids: DataFrame, level: int) -> DataFrame:
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
        return picks_of(rows, k, similarity, runs, level, "id", "text")
    found = paths(of_sets("picks"), bucket, picks_at).join(of_sets("sketch"), "id")
    linked = stored(components(candidate_links(found, similarity - 0.3, similarity + 0.02)), "candidate-components")
    members = linked.join(classes.select(F.col("representative").alias("id"), "n", "copies"), "id")
    exact = stored(exact_links(members, docs, k, similarity, id_col, text, most_shingles), "exact-links")
    class_of = components(exact.filter("label <> id").select(F.col("id").alias("a"), F.col("label").alias("b")))
    counted = exact.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(counted.withColumnRenamed("id", "representative"), "representative", "left").join(
        class_of.withColumnRenamed("id", "representative"), "representative", "left")
    of_doc = signed.select("id", *same).distinct().join(known, same)
    result = of_doc.select(F.col("id").alias("_id"), F.coalesce("component", "representative").alias("class_id"),
                           (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", "representative")
    every = docs.select(F.col(id_col).cast("long").alias(id_col)).distinct()
    return every.join(result, F.col(id_col) == F.col("_id"), "left").select(
        id_col, F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("representative", id_col).alias("representative"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """docs with only the smallest identifier of each class; rows without id stay. Columns are unchanged."""
    dropped = stored(near_duplicates(docs, **settings).filter("doc_id <> class_id").select("doc_id"), "near-copies")
    return docs.join(dropped.distinct(), "doc_id", "left_anti")
