import numpy as np
import pytest

from citegrove.llm.suffix_dedup import sliding_min, without_repeats


def brute(rows, length):
    seen: dict[bytes, set] = {}
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s:s + length], set()).add(i)
    out = []
    for (i, b), (doc, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if min(seen[b[s:s + length]]) < i:
                gone[s:s + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[:-1].astype(int), [0]]))).reshape(-1, 2)
        out.append((doc, len(b), int(gone.sum()), [tuple(x) for x in edge.tolist()], bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return sorted(out, key=str)


def corpus():
    r = np.random.default_rng(4)
    def text(n):
        return "".join(r.choice(list("abcdé "), n))
    shared = [text(n) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        parts = [text(int(r.integers(0, 90))) for _ in range(3)]
        for s in r.integers(0, len(shared), 2):
            a = int(r.integers(0, 10)) if i % 4 == 0 else 0
            parts.insert(int(r.integers(0, 3)), shared[int(s)][a:])
        rows.append((int(r.integers(0, 10_000)), "".join(parts)))
    rows += [(20_000, rows[3][1]), (20_001, rows[3][1]), (20_001, rows[3][1]), (20_002, None), (20_003, ""), (None, rows[5][1]), (None, rows[5][1]),
             (20_004, "a" * 300), (20_005, "a" * 120), (20_006, "the " * 100), (20_007, "b" + "the " * 60), (20_008, shared[4][::-1] * 3), (-5, shared[3])]
    return rows


@pytest.mark.parametrize("block", [300, 2 << 20])
def test_same_as_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block long, runs string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in without_repeats(df, block_bytes=block).collect()]
    assert sorted(got, key=str) == brute(rows, 50)


def test_other_lengths_and_empty_table(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in without_repeats(df, length=7, part=4).collect()]
    assert sorted(got, key=str) == brute(rows, 7)
    assert without_repeats(df.filter("false")).count() == 0
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    assert sliding_min(x, 3).tolist() == [3, 1, 1, 1, 2]
