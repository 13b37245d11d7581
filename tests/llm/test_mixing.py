import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrove.llm.mixing import find_exponent, mixed, mixing_plan


def documents(spark):
    sizes = {"big": 300, "mid": 60, "small": 12, None: 6, "none": 2}
    rows = [(1000 * k + i, "" if s == "none" else "w " * (1 + i % 7), s, i) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, "a b", "small", 0), (99_999, None, "big", 0)],
                                 "doc_id long, text string, source string, weight long")


def test_exponent_is_the_bisected_one(spark):
    totals = spark.createDataFrame([("a", 800), ("b", 150), ("c", 50), ("z", 0)], "source_key string, tokens long")
    p = np.array([800, 150, 50]) / 1000

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum()
    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(middle) > 0.9 else (low, middle)
    assert abs(find_exponent(totals, 0.9, None) - high) < 1e-6
    assert abs(find_exponent(totals, None, 4.0) - (1 - np.log(4) / np.log(16))) < 1e-6
    with pytest.raises(ValueError):
        find_exponent(totals, None, None)


@pytest.mark.parametrize("budget", [None, 400])
def test_plan_keeps_budget_and_order(spark, budget):
    docs = documents(spark)
    plan = mixing_plan(docs, max_repeats=3.0, budget=budget, block_tokens=100, seed=1)
    got = plan.toPandas()
    totals = docs.groupBy(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("s")).agg(
        F.sum(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))).alias("t")).toPandas().set_index("s").t
    assert abs(got.groupby("source_key").weight.first().sum() - 1) < 1e-9
    w = got.groupby("source_key").weight.first()
    cover = budget or max(totals[s] / w[s] for s in w.index if w[s] > 0)
    for s, part in got.groupby("source_key"):
        whole = part.tokens.sum()
        if totals[s] == 0:
            assert len(part) == 2 and (part.epoch == 0).all()
            continue
        assert cover * w[s] - 1e-6 <= whole < cover * w[s] + 24 + 1e-6 or whole == cover * w[s]
        assert whole / totals[s] < 3.0 + 24 / totals[s] + 1e-6
        for _, e in part[part.epoch < part.epoch.max()].groupby("epoch"):
            assert e.tokens.sum() == totals[s]
    for _, b in got.groupby("block"):
        assert sorted(b.slot) == list(range(1, len(b) + 1))
        assert b.tokens.sum() <= 100 + 24 * 5
    if budget is None:
        ids = {r.doc_id for r in docs.collect()}
        assert {None if x != x else int(x) for x in got.doc_id} == ids
        assert sorted(got.block.unique()) == list(range(got.block.max() + 1))


def test_mixed_rows_and_empty_table(spark):
    docs = documents(spark)
    uses = mixing_plan(docs, max_repeats=2.0).agg(F.sum("uses")).first()[0]
    out = mixed(docs, max_repeats=2.0)
    assert out.columns == docs.columns and out.count() == uses >= docs.count()
    none = docs.filter("false")
    assert mixing_plan(none, max_repeats=2.0).count() == 0 and mixed(none, target_entropy=1.0).count() == 0


def test_mixed_rows_stand_in_the_order_of_the_plan(spark):
    docs = documents(spark).repartition(3)
    for settings in ({"max_repeats": 3.0, "block_tokens": 100, "seed": 1}, {"max_repeats": 3.0, "budget": 400, "block_tokens": 40}):
        plan = mixing_plan(docs, **settings).orderBy("block", "slot").collect()
        wanted = [(r.doc_id, r.source_key) for r in plan for _ in range(r.uses)]
        got = [(r.doc_id, "null" if r.source is None else "=" + r.source) for r in mixed(docs, **settings).collect()]
        assert got == wanted and len({r.block for r in plan}) > 3
