"""Greedy choice among overlapping spans."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from citegrove.rules import KIND_PRIORITY


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def islands(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end",
            block: int = 65536) -> DataFrame:
    """Adds `island`: spans of a document that touch, directly or through others, share one.  Choices in one island
    never affect another, so folds work on islands of a few spans however many a document has.  Reach is summed up per
    block of text first, so one document with a third of all spans still spreads over many tasks."""
    blocks = spans.withColumn("_b", (F.col(start) / block).cast("bigint"))
    # how far earlier blocks reach: one row per block, so this window is short even for a huge document
    ends = blocks.groupBy(*keys, "_b").agg(F.max(end).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_b", F.max("_end").over(earlier).alias("_carry"))
    order = Window.partitionBy(*keys, "_b").orderBy(start, end)
    reach = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    marked = blocks.join(carry, [*keys, "_b"]).withColumn(
        "_opens", F.when(F.coalesce(F.col(start) >= reach, F.lit(True)), F.col(start)))
    opened = marked.groupBy(*keys, "_b").agg(F.max("_opens").alias("_last"))
    before = opened.select(*keys, "_b", F.max("_last").over(earlier).alias("_before"))
    here = F.max("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (marked.join(before, [*keys, "_b"]).withColumn("island", F.coalesce(here, F.col("_before")))
            .drop("_b", "_carry", "_opens", "_before"))


def islands_of_texts(spans: DataFrame, keys: list[str]) -> DataFrame:
    """`islands` for spans read from texts: the spans of a document came out of one row, so its window is as bounded
    as the text and one shuffle is enough."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_opens", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), F.col("start")))
    return marked.withColumn("island", F.max("_opens").over(
        order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def resolve_overlaps(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keeps disjoint spans: higher priority first, then longer, then detector and text order."""
    keys = list(keys)
    rank = F.create_map(*[F.lit(x) for kv in KIND_PRIORITY.items() for x in kv])
    body = [c for c in spans.columns if c not in keys]
    ranked = islands_of_texts(spans.filter("start IS NOT NULL AND end > start"), keys)
    entry = F.struct(F.try_element_at(rank, F.col("kind")).alias("_prio"), (F.col("start") - F.col("end")).alias("_len"),
                     F.col("detector").alias("_det"), F.col("start").alias("_pos"), *body)
    grouped = ranked.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    kept = F.aggregate("_all", F.slice("_all", 1, 0), lambda acc, s: F.when(
        F.exists(acc, lambda k: _overlaps(k, s)), acc).otherwise(F.concat(acc, F.array(s))))
    return (grouped.withColumn("_s", F.explode(F.when(F.size("_all") == 1, F.col("_all")).otherwise(kept)))
            .select(*keys, *[F.col("_s")[c].alias(c) for c in body]))
