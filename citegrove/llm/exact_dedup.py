"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.common import ascii_lower, stored


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, digest, n_bytes, second) of every row: SHA-256, length and a second digest of the text with A-Z lower-cased."""
    plain = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), plain.alias("plain")).select(
        "id", F.sha2(F.col("plain").cast("binary"), 256).alias("digest"),
        F.octet_length("plain").cast("long").alias("n_bytes"), F.xxhash64("plain").alias("second"))


def leaf_runs(rows: DataFrame, runs: int) -> DataFrame:
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(runs)).alias("run"), "digest", "n_bytes", "second",
                       F.col("id").alias("low"), F.col("id").alias("high"), F.lit(1).cast("long").alias("size"))


def merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """One binomial round: runs r, r+1, ..., r+fan_in-1 meet in run r / fan_in. Equal entries become one, which keeps the
    smallest and largest identifier and the number of rows; length and second digest are part of the key, so entries merge
    only where all three agree. Equal entries of a task are combined before they travel."""
    return (runs.withColumn("run", F.floor(F.col("run") / fan_in))
            .groupBy("run", "digest", "n_bytes", "second")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size"))
            .sortWithinPartitions("run", "digest"))


def merged_runs(rows: DataFrame, runs: int = 64, fan_in: int = 8) -> DataFrame:
    """All runs merged into one sorted run, dealt over the cluster by digest: one row per distinct text."""
    level, left = leaf_runs(rows, runs), runs
    while left > 1:
        level, left = merge_round(level, fan_in), -(-left // fan_in)
    return level.drop("run")


def exact_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: str = "smallest",
                     runs: int = 64, fan_in: int = 8) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null counts as empty. A null identifier never stays while its
    group has another; rows of one identifier and text (repeated rows) count in group_size and are all marked kept if the
    identifier is. keep: "smallest" or "largest" identifier. An empty table gives no rows; other columns are ignored."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    rows = stored(digests(docs, text, id_col), "digests")
    key = ["digest", "n_bytes", "second"]
    merged = merged_runs(rows, runs, fan_in).select(
        *key, F.col("low" if keep == "smallest" else "high").alias("keep_id"), F.col("size").alias("group_size"))
    return rows.join(merged, key).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs without the rows whose text another row keeps; of repeated rows (one identifier, one text) one stays. Columns are
    unchanged, whatever their names. A row stays by its identifier and text together, so that of two texts of one identifier only
    the one that the identifier keeps does; null texts count as empty, a null identifier stays where its text has no other. The texts
    are dealt anew only once, and a second time only where repeated rows exist."""
    one, two = ("_" + uuid.uuid4().hex for _ in range(2))
    found = exact_duplicates(docs, keep=keep).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    found = stored(found.filter("stays").groupBy(F.col("doc_id").alias(one), F.col("text_sha256").alias(two)).agg(F.count("*").alias("rows")), "kept")
    digest = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    left = docs.join(found.select(one, two), F.col("doc_id").eqNullSafe(F.col(one)) & (digest == F.col(two)), "left_semi")
    if not found.filter("rows > 1").take(1):
        return left
    return left.withColumn(two, digest).dropDuplicates(["doc_id", two]).drop(two)
