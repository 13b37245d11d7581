"""Tables in the shared folder, text buffers and word hashes used by several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="citegrove-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000):
    """From now on texts go to Python in batches of at most `rows`. A batch stands in the memory of the executor and of its
    worker at once, beside the heap; operators read it in chunks anyway."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(df: DataFrame, modulus: int) -> DataFrame:
    """Adds _fold: crc32 of doc_id as text, modulo modulus."""
    return df.withColumn("_fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each (one row at least), so that temporary arrays stay small."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end
        row = end


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the rows, one after the other, and the place of each row's first word (and the end). A word is a run of
    bytes other than ASCII white space; null has none."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat = lists.flatten()
    solid = np.asarray(pc.greater(pc.binary_length(flat), 0))
    bounds = np.concatenate([[0], np.cumsum(solid)])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    return flat.filter(pa.array(solid)), bounds.astype(np.int64)


_RANDOM = np.random.default_rng(20240229)
BYTE_VALUES = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WORD_BYTES = BYTE_VALUES[_LOWER]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, 64-bit hash, row) of every word: a run of bytes other than ASCII white space, read without
    regard to the case of A-Z. Words never cross rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(WORD_BYTES[data] * _power(BASE, "up", n), out=total[1:])
    h = (total[end] - total[start]) * _power(pow(BASE, -1, 2**64), "down", n)[start]
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, mix(h ^ (end - start).astype(np.uint64)), row


def grams(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every k consecutive words of one row."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[:n] == row[k - 1:])
    h = np.zeros(len(first), np.uint64)
    for i in range(k):
        h = h * np.uint64(BASE) + word[first + i]
    return mix(h), first


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables made of whole groups, from batches sorted by `keys`: a group is never split, and small groups come together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most_rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(rows, bool)
        for k in keys:
            column = t[k].to_numpy()
            last &= column == column[-1]
        cut = rows - int(last[::-1].argmin() if not last.all() else rows)
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Index of the first row of each group, and the number of rows at the end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = table[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
