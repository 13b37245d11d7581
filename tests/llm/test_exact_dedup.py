import hashlib

import pytest

from citegrove.llm.exact_dedup import exact_duplicates, without_copies
from citegrove.llm.mixing import mixed

ROWS = [(1, "A b"), (2, "a B"), (3, "Ä"), (4, "ä"), (5, None), (6, ""), (7, "A"), (7, "B"), (9, "b"), (10, "x" * 300_000), (11, "X" * 300_000),
        (12, "twice"), (12, "twice"), (12, "TWICE"), (None, "alone"), (None, "a b"), (13, "Alone too"), (13, "other")]


def brute(rows, keep):
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        kept = (max if keep == "largest" else min)(ids) if ids else None
        out.append((i, kept, len(groups[norm(t)]), i == kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_same_as_brute_force(spark, keep):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in ROWS], "doc_id long, text string, low int, digest int").repartition(3)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(df, keep=keep).collect()]
    assert sorted(got, key=str) == brute(ROWS, keep)


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(i, t, 1, "s", 3, 4) for i, t in ROWS], "doc_id long, text string, _id int, _source string, _hash int, _rows int")
    got = without_copies(df)
    assert got.columns == df.columns
    rows = sorted(((r.doc_id, (r.text or "")[:5].lower()) for r in got.collect()), key=str)
    assert rows == sorted([(2, "a b"), (3, "Ä".lower()), (4, "ä"), (6, ""), (7, "a"), (9, "b"), (11, "xxxxx"), (12, "twice"), (None, "alone"),
                           (13, "alone"), (13, "other")], key=str)
    assert len(rows) == 11


def test_empty_table_and_bad_setting(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(df).count() == without_copies(df).count() == 0
    with pytest.raises(ValueError):
        exact_duplicates(df, keep="any")


def test_mixing_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(i, f"word {i} " * 5, "a" if i % 5 else "b", i, "x", 1, 2, 3) for i in range(40)],
                               "doc_id long, text string, source string, _id long, _source string, _hash int, id int, epoch int")
    got = mixed(df, max_repeats=2.0)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == set(range(40))
