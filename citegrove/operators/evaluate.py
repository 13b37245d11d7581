"""Scoring of predicted spans against gold spans.

gold: doc_id, level, idx, start, end, label, ids (array of accepted ids)
pred: doc_id, idx, start, end, label, id, conf

Pairs are found by binning positions, so a document with a very large share of all spans is split over many tasks;
one-to-one matching folds islands of touching spans, never whole documents.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from citegrove.operators.overlaps import islands
from citegrove.plans.tables import stored
from citegrove.rules import BONUS_CAP, CONFIDENCE, ERROR_RATES, EXTRA_FRACTION, LABELS, LEVEL_WEIGHTS, MIN_IOU, \
    SEVERE_WEIGHT

BIN = 1024


def normalise_id(col: Column) -> Column:
    t = F.trim(col)
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?!$)", "")).otherwise(t)


def _blocks(cell: Column) -> Column:
    c = F.trim(F.coalesce(cell, F.lit("")))
    parts = F.transform(F.split(c, r"\|"), lambda b, i: F.struct(i.alias("pos"), F.trim(b).alias("b")))
    return F.when(c.isin("", "-"), F.array().cast("array<struct<pos:int,b:string>>")) \
        .otherwise(F.filter(parts, lambda x: x["b"] != ""))


def _fields(df: DataFrame, cell: str) -> DataFrame:
    keep = [c for c in df.columns if c != cell]
    return (df.select(*keep, F.explode(_blocks(F.col(cell))).alias("x"))
            .select(*keep, F.col("x.pos").alias("idx"), F.transform(F.split("x.b", ","), lambda f: F.trim(f)).alias("f")))


def parse_prediction_cells(df: DataFrame, cell: str = "cells") -> DataFrame:
    """One row per block of 'start,end,label,id,conf|...'; what is wrong with it stands in `errors`."""
    x = _fields(df, cell)
    get = lambda i: F.try_element_at("f", F.lit(i))
    label, raw_id, conf = F.lower(get(3)), get(4), get(5)
    start, end = get(1).try_cast("int"), get(2).try_cast("int")
    no_id, value = raw_id.isin("", "-"), conf.try_cast("double")
    size_ok = F.size("f") == 5
    errors = F.array_compact(F.array(
        F.when(~size_ok, "fields"), F.when(size_ok & (start.isNull() | end.isNull()), "integer"),
        F.when(size_ok & ((start < 0) | (end <= start)), "span"), F.when(size_ok & ~label.isin(LABELS), "label"),
        F.when(size_ok & (label == "real") & no_id, "real_without_id"),
        F.when(size_ok & (label == "real") & ~no_id & ~raw_id.rlike("^[0-9]+$"), "id_not_digits"),
        F.when(size_ok & ~conf.isin("", "-") & value.isNull(), "confidence"),
        F.when(size_ok & ((value < 0) | (value > 1)), "confidence_range")))
    keep = [c for c in df.columns if c != cell]
    return x.select(*keep, "idx", start.alias("start"), end.alias("end"), label.alias("label"),
                    F.when(~no_id, normalise_id(raw_id)).alias("id"), value.alias("conf"), errors.alias("errors"))


def parse_gold_cells(df: DataFrame, cell: str = "cells") -> DataFrame:
    """One row per block of 'start,end,label,id1:id2|...'."""
    x = _fields(df, cell)
    get = lambda i: F.try_element_at("f", F.lit(i))
    ids = F.array_distinct(F.transform(F.filter(F.split(F.coalesce(get(4), F.lit("")), ":"),
                                                lambda v: ~F.trim(v).isin("", "-")), lambda v: normalise_id(v)))
    label = F.lower(get(3))
    keep = [c for c in df.columns if c != cell]
    return x.select(*keep, "idx", get(1).try_cast("int").alias("start"), get(2).try_cast("int").alias("end"),
                    label.alias("label"), ids.alias("ids"),
                    F.array_compact(F.array(F.when((label == "real") & (F.size(ids) == 0), "real_without_ids"),
                                            F.when(F.size("f") != 4, "fields"))).alias("errors"))


def first_submission_row(df: DataFrame, key: str = "doc_id", order: str = "row_no") -> DataFrame:
    """Of several rows of a document the first counts; min_by reduces on the map side."""
    rest = [c for c in df.columns if c not in (key,)]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def coverage_check(gold_docs: DataFrame, pred_docs: DataFrame) -> DataFrame:
    """Gold documents without a row among the predictions."""
    return gold_docs.select("doc_id").distinct().join(pred_docs.select("doc_id"), "doc_id", "left_anti")


# ------------------------------------------------------------------ pairs

def _binned(df: DataFrame) -> DataFrame:
    return df.withColumn("bin", F.explode(F.sequence((F.col("start") / BIN).cast("bigint"),
                                                     ((F.col("end") - 1) / BIN).cast("bigint"))))


def overlapping_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair of spans of one document that overlap, once: both meet in the bin where the overlap begins.
    Columns of `a` get the prefix a_, of `b` b_."""
    left = _binned(a).select("bin", *[F.col(c).alias("a_" + c) for c in a.columns])
    right = _binned(b).select(F.col("bin").alias("b_bin"), *[F.col(c).alias("b_" + c) for c in b.columns])
    on = ((F.col("a_doc_id") == F.col("b_doc_id")) & (F.col("bin") == F.col("b_bin"))
          & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
          & (F.col("bin") == (F.greatest("a_start", "b_start") / BIN).cast("bigint")))
    common = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return left.join(right, on).drop("bin", "b_bin").withColumn("common", common)


def _iou() -> Column:
    return F.col("common") / ((F.col("a_end") - F.col("a_start")) + (F.col("b_end") - F.col("b_start")) - F.col("common"))


def span_iou_join(gold: DataFrame, pred: DataFrame, min_iou: float = MIN_IOU) -> DataFrame:
    return overlapping_pairs(gold.select("doc_id", "idx", "start", "end"), pred.select("doc_id", "idx", "start", "end")) \
        .select(F.col("a_doc_id").alias("doc_id"), F.col("a_idx").alias("gold_idx"), F.col("b_idx").alias("pred_idx"),
                F.col("a_start").alias("start"), F.greatest("a_end", "b_end").alias("end"), _iou().alias("iou")) \
        .filter(F.col("iou") >= min_iou)


def match_one_to_one(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Greedy by IoU, then gold index, then prediction index; each side once.  Almost every gold and prediction has a
    single candidate: those pairs are kept as they are, only the rest is folded, island by island."""
    pairs = span_iou_join(gold, pred)
    contested = (F.count("*").over(Window.partitionBy("doc_id", "gold_idx")) > 1) | \
        (F.count("*").over(Window.partitionBy("doc_id", "pred_idx")) > 1)
    marked = stored(pairs.withColumn("contested", contested), "span-pairs")
    sure = marked.filter(~F.col("contested")).select("doc_id", "gold_idx", "pred_idx", "iou")
    rest = islands(marked.filter("contested"), ["doc_id"])
    entry = F.struct((-F.col("iou")).alias("o"), "gold_idx", "pred_idx", "iou")
    grouped = rest.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, s: F.when(F.exists(
        acc, lambda k: (k["gold_idx"] == s["gold_idx"]) | (k["pred_idx"] == s["pred_idx"])), acc)
        .otherwise(F.concat(acc, F.array(s))))
    folded = grouped.select("doc_id", F.explode(kept).alias("m")).select("doc_id", "m.gold_idx", "m.pred_idx", "m.iou")
    return sure.unionByName(folded)


def judged(gold: DataFrame, pred: DataFrame, matches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """gold with `pred_idx` and pred with `gold_idx` (NULL: unmatched).  Matches and both tables are written once, as the
    counts below read them several times."""
    m = (stored(match_one_to_one(gold, pred), "matches") if matches is None else matches).select("doc_id", "gold_idx", "pred_idx")
    golds = gold.join(m.withColumnRenamed("gold_idx", "idx"), ["doc_id", "idx"], "left")
    preds = pred.join(m.withColumnRenamed("pred_idx", "idx"), ["doc_id", "idx"], "left")
    return stored(golds, "judged-gold"), stored(preds, "judged-pred")


def _inside_matched(golds: DataFrame, preds: DataFrame) -> DataFrame:
    used, free = golds.filter("pred_idx IS NOT NULL"), preds.filter("gold_idx IS NULL")
    inside = overlapping_pairs(used.select("doc_id", "idx", "start", "end"), free.select("doc_id", "idx", "start", "end"))
    return (inside.filter(F.col("common") / (F.col("b_end") - F.col("b_start")) >= EXTRA_FRACTION)
            .select(F.col("b_doc_id").alias("doc_id"), F.col("b_idx").alias("idx")).distinct())


def component_extra(gold: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Unmatched predictions that lie (90 %) inside a matched gold; they are not counted."""
    return _inside_matched(*judged(gold, pred, matches))


def _spurious(golds: DataFrame, preds: DataFrame) -> DataFrame:
    return preds.filter("gold_idx IS NULL").join(_inside_matched(golds, preds), ["doc_id", "idx"], "left_anti")


def matched_rows(golds: DataFrame, preds: DataFrame) -> DataFrame:
    """Matched pairs side by side: g_* and p_* columns, `hit` (right class and link)."""
    g = golds.filter("pred_idx IS NOT NULL").select("doc_id", "pred_idx", *[F.col(c).alias("g_" + c) for c in golds.columns if c != "doc_id"])
    p = preds.filter("gold_idx IS NOT NULL").select("doc_id", F.col("idx").alias("pred_idx"), *[
        F.col(c).alias("p_" + c) for c in preds.columns if c != "doc_id"])
    same = F.col("g_label") == F.col("p_label")
    linked = (F.col("g_label") != "real") | F.coalesce(F.array_contains("g_ids", F.col("p_id")), F.lit(False))
    return g.join(p, ["doc_id", "pred_idx"]).withColumn("same", same).withColumn("hit", same & linked)


def confusion_events(gold: DataFrame, pred: DataFrame, doc_levels: DataFrame) -> DataFrame:
    """Long list (level, label, metric, value) whose sums are the counts of the metric."""
    golds, preds = judged(gold, pred)
    rows = matched_rows(golds, preds)
    n = F.lit(1.0)

    def event(label: Column | str, metric: str, value: Column = n) -> Column:
        return F.struct((F.col(label) if isinstance(label, str) else label).alias("label"), F.lit(metric).alias("metric"),
                        value.cast("double").alias("value"))
    y = F.when(F.col("hit"), 1.0).otherwise(0.0)
    no = F.lit(None)
    pair_events = F.array_compact(F.array(
        F.when(F.col("hit"), event("g_label", "tp")).otherwise(no),
        F.when(F.col("same") & ~F.col("hit"), event("p_label", "fp")),
        F.when(~F.col("same"), event("g_label", "fn")), F.when(~F.col("same"), event("p_label", "fp")),
        F.when((F.col("g_label") == "inventada") & (F.col("p_label") == "real"), event(F.lit("-"), "severe")),
        F.when(F.col("p_conf").isNotNull(), event(F.lit("-"), "brier_n")),
        F.when(F.col("p_conf").isNotNull(), event(F.lit("-"), "brier_sum", (F.col("p_conf") - y) ** 2))))
    paired = rows.select(F.col("g_level").alias("level"), F.explode(pair_events).alias("e")).select("level", "e.*")
    of_gold = golds.select("level", F.explode(F.array_compact(F.array(
        event("label", "support"), F.when(F.col("label") == "inventada", event(F.lit("-"), "invented")),
        F.when(F.col("pred_idx").isNull(), event("label", "fn"))))).alias("e")).select("level", "e.*")
    spurious = _spurious(golds, preds).join(doc_levels, "doc_id").select("level", "label", F.lit("fp").alias("metric"), n.alias("value"))
    return paired.unionByName(of_gold).unionByName(spurious)


def _sums(events: DataFrame, *keys: str) -> DataFrame:
    """The sum of each metric as a column, in one pass."""
    def total(metric: str) -> Column:
        return F.sum(F.when(F.col("metric") == metric, F.col("value")).otherwise(0.0)).alias(metric)
    return events.groupBy(*keys).agg(*[total(m) for m in ("tp", "fp", "fn", "support", "severe", "invented", "brier_sum", "brier_n")])


def confusion_counts(events: DataFrame) -> DataFrame:
    """level, label, tp, fp, fn, support."""
    counts = _sums(events.filter("label <> '-'"), "level", "label")
    return counts.select("level", "label", *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "support")])


def level_scores(events: DataFrame) -> DataFrame:
    """Macro-F1, severe error rate, Brier bonus and score of every level, from one aggregate of the events."""
    f1 = F.when((F.col("label") != "-") & (F.col("support") > 0), F.coalesce(
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    out = _sums(events, "level", "label").withColumn("f1", f1).groupBy("level").agg(
        F.avg("f1").alias("macro_f1"), *[F.sum(c).alias(c) for c in ("severe", "invented", "brier_sum", "brier_n")])
    brier = F.try_divide("brier_sum", "brier_n")
    out = out.withColumn("tau", F.coalesce(F.try_divide("severe", "invented"), F.lit(0.0)))
    out = out.withColumn("s", F.col("macro_f1") * (1 - SEVERE_WEIGHT * F.col("tau"))).withColumn(
        "bonus", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(BONUS_CAP), BONUS_CAP * (1 - brier))), F.lit(0.0)))
    return out.select("level", "macro_f1", "tau", "s", "bonus", (F.col("s") * (1 + F.col("bonus"))).alias("score"))


def final_score(levels: DataFrame) -> DataFrame:
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVEL_WEIGHTS.items() for x in kv]),
                                         F.col("level").cast("int")), F.lit(1.0))
    return levels.filter("macro_f1 IS NOT NULL").agg(
        (F.sum(weight * F.col("score")) / F.sum(weight)).alias("final_score"))


def span_conflicts(spans: DataFrame, min_iou: float | None = MIN_IOU) -> DataFrame:
    """Pairs of spans of one document that overlap: with IoU of at least `min_iou`, or at all when it is None."""
    p = overlapping_pairs(spans, spans).filter(F.col("a_idx") < F.col("b_idx")).withColumn("iou", _iou())
    p = p if min_iou is None else p.filter(F.col("iou") >= min_iou)
    return p.select(F.col("a_doc_id").alias("doc_id"), F.col("a_idx").alias("idx_a"), F.col("b_idx").alias("idx_b"), "iou")


def error_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row per error: CLASSE, LINK, FALTOU or SOBROU, with a flag for the severe kind."""
    golds, preds = judged(gold, pred)
    wrong = matched_rows(golds, preds).filter(~F.col("hit")).select(
        "doc_id", F.col("g_start").alias("start"), F.when(F.col("same"), "LINK").otherwise("CLASSE").alias("error"),
        F.col("g_label").alias("expected"), F.col("p_label").alias("predicted"),
        ((F.col("g_label") == "inventada") & (F.col("p_label") == "real")).alias("severe"))
    missed, extra = golds.filter("pred_idx IS NULL"), _spurious(golds, preds)
    null, no = F.lit(None).cast("string"), F.lit(False)
    return (wrong.unionByName(missed.select("doc_id", "start", F.lit("FALTOU").alias("error"), F.col("label").alias(
        "expected"), null.alias("predicted"), no.alias("severe")))
        .unionByName(extra.select("doc_id", "start", F.lit("SOBROU").alias("error"), null.alias("expected"),
                                  F.col("label").alias("predicted"), no.alias("severe"))))


def accuracy_by_situation(judged: DataFrame, profile: str = "padrao") -> DataFrame:
    """situation, n, accuracy, adopted confidence; situations never met stay with n = 0."""
    table = judged.sparkSession.createDataFrame(list(CONFIDENCE[profile].items()), "situation string, confidence double")
    seen = judged.groupBy("situation").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
    return seen.join(table, "situation", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))


def situation_mix(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("situation").agg(F.count_if(F.col("level") == 1).alias("level_1"),
                                              F.count_if(F.col("level") == 2).alias("level_2"))


def expected_brier(mix: DataFrame, profiles: DataFrame) -> DataFrame:
    """Expected bonus per error rate, error model and profile over a mix (situation, level_1, level_2), and the gain
    over the profile that always says 1.  The mix has one row per situation, so every side here is a small table."""
    long = mix.select("situation", F.expr("stack(2, 1, level_1, 2, level_2) AS (level, k)")).filter("k > 0")
    totals = long.groupBy("level").agg(F.sum("k").alias("n"), F.sum(F.when(
        F.col("situation").startswith("inventada"), F.col("k")).otherwise(0)).alias("n_risk"))
    cases = long.join(totals, "level").select("*", F.explode(F.array(*[F.lit(r) for r in ERROR_RATES])).alias("rate")) \
        .select("*", F.explode(F.array(F.lit("uniforme"), F.lit("concentrado"))).alias("model")).join(profiles, "situation")
    e = F.when(F.col("model") == "uniforme", F.col("rate")).when(
        F.col("situation").startswith("inventada"), F.least(F.lit(1.0), F.col("rate") * F.col("n") / F.col("n_risk"))) \
        .otherwise(0.0)
    c = F.col("confidence")
    brier = cases.groupBy("model", "rate", "profile", "level").agg(
        (F.sum(F.col("k") * ((1 - e) * (1 - c) ** 2 + e * c ** 2)) / F.first("n")).alias("brier"))
    weight = F.when(F.col("level") == 1, 1.0).otherwise(2.0)
    bonus = brier.groupBy("model", "rate", "profile").agg((F.sum(weight * BONUS_CAP * (1 - F.col("brier"))) / 3).alias("bonus"))
    one = bonus.filter("profile = 'um'").select("model", "rate", F.col("bonus").alias("ref"))
    return bonus.join(one, ["model", "rate"]).select("model", "rate", "profile", "bonus",
                                                     (F.col("bonus") - F.col("ref")).alias("gain"))


def oracle_predictions(gold: DataFrame) -> DataFrame:
    """Gold fed back as predictions: the ceiling of the score."""
    return gold.select("doc_id", "idx", "start", "end", "label", F.try_element_at("ids", F.lit(1)).alias("id"),
                       F.lit(1.0).alias("conf"))


