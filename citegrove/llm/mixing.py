"""Temperature mixing of sources: exponent search, then budgeted block permutations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrove.llm.common import stored

POINTS, ROUNDS = 32, 6


def words_of(text: str = "text") -> Column:
    """Tokens as this operator counts them by default: words between white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def find_exponent(totals: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent a in w ~ share^a that meets the target entropy (nats), or the smallest in 0..1 under which no source is
    repeated more than max_repeats times when the largest source is read once. Both sides are monotone in a, so the interval
    is cut into POINTS parts ROUNDS times; every round is one aggregate over the sources, which stay in Spark."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    every, largest = totals.select(F.sum("tokens"), F.max("tokens")).first()
    total = totals.filter("tokens > 0")
    low, high = 0.0, 1.0 if target_entropy is None else 8.0
    for _ in range(ROUNDS):
        step = (high - low) / POINTS
        tried = F.explode(F.array(*[F.lit(low + i * step) for i in range(POINTS + 1)])).alias("a")
        log_share = F.log(F.col("tokens") / F.lit(every))
        if target_entropy is None:
            each = total.select(tried, F.log(F.col("tokens") / F.lit(largest)).alias("r"))
            seen = each.groupBy("a").agg(F.max((F.col("a") - 1) * F.col("r")).alias("y"))
            limit = F.log(F.lit(float(max_repeats)))
        else:
            each = total.select(tried, log_share.alias("r"))
            z, zr = F.sum(F.exp(F.col("a") * F.col("r"))), F.sum(F.col("a") * F.col("r") * F.exp(F.col("a") * F.col("r")))
            seen = each.groupBy("a").agg((F.log(z) - zr / z).alias("y"))
            limit = F.lit(float(target_entropy))
        met = [r.a for r in seen.filter(F.col("y") <= limit + 1e-12).select("a").collect()]
        best = min(met, default=high)
        low, high = max(low, best - step), best
    return high


def mixing_plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None,
                block_tokens: int = 1 << 20, seed: int = 0, id_col: str = "doc_id", text: str = "text", source: str = "source",
                tokens: Column | None = None) -> DataFrame:
    """One row per use of a document: id_col, text_hash, source_key, tokens, uses (equal rows that go together), epoch, block,
    slot, weight.

    Source weights are the token shares to the power found by find_exponent, normalised. The budget in tokens defaults to what
    reads the largest source relative to its weight just once, so that every document is used. Each source is read in
    epochs; an epoch is a random permutation of its documents, the last one stops where the source's share of the budget is
    reached. A block takes weight * block_tokens of each source, in a random order given by slot; blocks follow each
    other. A source without any token is used once, in block 0. Null sources are one source, null texts have no tokens, rows of
    equal id, source and text go together, an empty table gives no rows, other columns are ignored.

    Running sums go over buckets of the permutations, not over a source, so that one large source spreads over many tasks."""
    placed = in_blocks(placed_uses(docs, target_entropy, max_repeats, budget, seed, id_col, text, source, tokens), block_tokens)
    order = Window.partitionBy("block").orderBy(*order_in_block(seed))
    return placed.select(F.col("id").alias(id_col), "text_hash", "source_key", "tokens", "uses", "epoch", "block", F.row_number().over(order).alias("slot"), "weight")


def in_blocks(placed: DataFrame, block_tokens: int) -> DataFrame:
    """Adds block: which part of `weight * block_tokens` tokens of its source a use falls in."""
    block = F.when(F.col("weight") > 0, F.floor(F.least("at", F.greatest(F.col("wanted") - 1, F.lit(0))) / (F.col("weight") * block_tokens))).otherwise(0)
    return placed.withColumn("block", block.cast("long"))


def order_in_block(seed: int) -> list[Column]:
    """The random order of the uses of a block."""
    return [F.xxhash64(F.lit(seed), "r"), *map(F.col, ("id", "source_key", "text_hash", "epoch"))]


def permuted(seed: int, epoch, buckets) -> tuple[Column, Column]:
    """Place of a row (id, text_hash, source_key) in the permutation of an epoch: its bucket, and a hash that orders the bucket."""
    r = F.xxhash64(F.lit(seed), "id", "text_hash", "source_key", epoch)
    return F.floor(F.pmod(r, F.lit(1 << 30)) * buckets / (1 << 30)), r


def placed_uses(docs: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None, seed: int, id_col: str, text: str,
                source: str, tokens: Column | None) -> DataFrame:
    """Every use that the plan makes of a document: id, text_hash, source_key, tokens, uses, its place (epoch, bucket, r), the tokens of the source read
    before it (at), whether that is within the source's budget (else it is used because it has no tokens), and t, weight, wanted, buckets of the source."""
    size = words_of(text) if tokens is None else tokens
    unit = stored(docs.select(F.col(id_col).alias("id"), source_key(source).alias("source_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
                              size.alias("tokens")).groupBy("id", "source_key", "text_hash")
                  .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses")), "mixing-units")
    totals = stored(unit.groupBy("source_key").agg(F.sum("tokens").alias("tokens")), "mixing-sources")
    exponent = find_exponent(totals, target_entropy, max_repeats)
    every = totals.agg(F.sum("tokens")).first()[0] or 1
    raw = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(every)), F.lit(exponent))).otherwise(0.0)
    shares = totals.withColumnRenamed("tokens", "t").withColumn("raw", raw)
    z, cover = shares.select(F.sum("raw"), F.max(F.when(F.col("raw") > 0, F.col("t") / F.col("raw")))).first()
    shares = shares.withColumn("weight", F.col("raw") / F.lit(z or 1.0))
    wanted = F.lit(float(budget)) * F.col("weight") if budget is not None else F.lit(cover or 0.0) * F.col("raw")
    shares = shares.select("source_key", "t", "weight", wanted.alias("wanted"),
                           F.greatest(F.lit(1), F.least(F.lit(65_536), F.ceil(F.col("t") / (1 << 18)))).alias("buckets"))
    epochs = F.when(F.col("t") > 0, F.greatest(F.lit(0), F.ceil(F.col("wanted") / F.col("t") - 1e-9))).otherwise(1).cast("int")
    each = unit.join(shares, "source_key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(epochs, F.lit(1)) - 1))).filter(epochs > 0)
    bucket, r = permuted(seed, F.col("epoch"), F.col("buckets"))
    each = each.withColumn("bucket", bucket).withColumn("r", r)
    key = ["source_key", "epoch", "bucket"]
    sums = each.groupBy(*key).agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("source_key", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy(*key).orderBy("r", "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.join(sums, key).withColumn(
        "at", F.col("epoch") * F.col("t") + F.col("bucket_start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = placed.withColumn("within", (F.col("at") < F.col("wanted") - 1e-6 * F.col("t")) | (F.col("t") == 0))
    return placed.filter(F.col("within") | ((F.col("tokens") == 0) & (F.col("epoch") == 0)))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float | None = None,
          max_repeats: float | None = None, budget: int | None = None, seed: int = 0, tokens: Column | None = None, block_tokens: int = 1 << 20) -> DataFrame:
    """docs as often as the plan uses them and in its order, block by block and slot by slot; columns unchanged, whatever their names.

    The plan is made of keys alone. What a row needs of it is one small table of the buckets: how far a bucket is read, and where
    in it the blocks begin. By it a row decides how often it stands and in which blocks, so that texts move once, into their
    order: each file that is written holds a run of it. Nulls and repeated rows are as in mixing_plan."""
    place = F.struct("r", "id", "text_hash")
    used = in_blocks(placed_uses(docs, target_entropy, max_repeats, budget, seed, id_col, text, source, tokens), block_tokens)
    begins = used.groupBy("source_key", "epoch", "bucket", "block").agg(
        F.min(place).alias("place"), F.max(F.when(F.col("within"), place)).alias("end"), F.first("buckets").alias("buckets"))
    reads = stored(begins.groupBy("source_key", "epoch", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("place", "block"))).alias("begins"), F.max("end").alias("end"), F.first("buckets").alias("buckets")), "mixing-reads")
    sources = stored(reads.groupBy("source_key").agg(F.max("epoch").alias("epochs"), F.first("buckets").alias("buckets")), "mixing-ends")
    every = "_" + uuid.uuid4().hex
    size = words_of(f"{every}.{text}") if tokens is None else F.col(f"{every}._tokens")
    row = docs if tokens is None else docs.withColumn("_tokens", tokens)
    rows = row.select(F.struct("*").alias(every), F.col(id_col).alias("id"), source_key(source).alias("source_key"),
                      F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    rows = rows.join(sources, "source_key").withColumn("epoch", F.explode(F.sequence(F.lit(0), "epochs")))
    bucket, r = permuted(seed, F.col("epoch"), F.col("buckets"))
    rows = rows.withColumn("bucket", bucket).withColumn("r", r).drop("buckets").join(reads, ["source_key", "epoch", "bucket"])
    kept = rows.filter((place <= F.col("end")) | ((F.col("epoch") == 0) & (size == 0)))
    block = F.element_at(F.filter("begins", lambda b: b["place"] <= place), -1)["block"]
    return kept.orderBy(block, *order_in_block(seed)).select(*[F.col(f"{every}.`{c}`") for c in docs.columns])
