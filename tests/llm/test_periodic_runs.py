import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from citegrove.llm import queries
from citegrove.llm.periodic_runs import periodic_runs, runs_of


def brute(words, min_length=6, min_exponent=4):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(min_length, min_exponent * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(r):
    k, out = r.choice([1, 2, 3, 6]), []
    for _ in range(r.randint(0, 5)):
        unit = [r.choice("abcdéf"[:k]) for _ in range(r.randint(1, 5))]
        out += (unit * r.randint(1, 8))[:r.randint(0, 30)]
    return out


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (4, 3), (12, 2)])
def test_runs_same_as_brute_force(limits):
    r = random.Random(5)
    for _ in range(300):
        docs = [random_words(r) for _ in range(r.randint(1, 4))]
        bounds = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        word = np.array([ord(x) for d in docs for x in d], np.int32)
        expected = sorted(((s + int(bounds[i]), n, q) for i, d in enumerate(docs) for s, n, q in brute(d, *limits)), key=lambda x: (x[0], x[2]))
        assert [tuple(x) for x in runs_of(word, bounds, *limits).tolist()] == expected


def test_operator_on_odd_rows(spark):
    r = random.Random(9)
    texts = [" ".join(random_words(r)) for _ in range(60)]
    texts += [None, "", "  \t\n", "a " * 3000, "\x0b" + "x y\x0c" * 400 + "\n", "A a " * 9, "\x1c\x85 " * 8, "the end"]
    rows = [(i if i % 7 else None, t, "r", i) for i, t in enumerate(texts)]
    rows += rows[-3:]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    got = sorted(((x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in periodic_runs(df).collect()), key=str)
    expected = []
    for i, t, _, _ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        expected.append((i, len(words), brute(words), collapsed(words, brute(words))))
    assert got == sorted(expected, key=str)
    assert periodic_runs(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, min_exponent=1)


def test_query_same_as_brute_force(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["aa", "b", "ccc", "d"]) for _ in range(r.randint(0, 120)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "a a a a a a a"), (202, "  x\ty " * 50), (203, "q " * 41), (203, "q " * 41)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    expected, touched = [], 0
    for i, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            touched += 1
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                         sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs))))
    assert touched > 5
    assert got == sorted(expected, key=str)
