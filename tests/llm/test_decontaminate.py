import random
import re

import numpy as np
import pyarrow as pa
import pytest

from citegrove.llm import queries
from citegrove.llm.decontaminate import contaminated, plain_words
from citegrove.llm.fm_index import FMIndex, WaveletMatrix


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, window):
    held = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            held.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, names = words_of(text), set(), set()
        for m in {len(k) for k in held}:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in held:
                    hit |= set(range(i, i + m))
                    names |= held[tuple(w[i:i + m])]
        out.append((doc, len(w), len(hit), sorted(str(n) for n in names if n is not None)))
    return sorted(out, key=str)


def corpus(r):
    vocabulary = ["a", "B", "cc", "É", "9x", "the", "The", "日本"]
    phrase = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(r.randint(1, 40))) for i in range(25)]
    items += [(1, items[2][1]), (100, None), (101, ""), (102, "!?"), (None, phrase(14)), (103, items[4][1]), (103, items[4][1]), (104, "q-q'q")]
    docs = []
    for i in range(120):
        parts = [phrase(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items)[1] or "").split(" ")
            a = r.randint(0, max(0, len(w) - 3))
            parts.insert(r.randint(0, len(parts)), r.choice([", ", "\n", "--"]).join(w[a:a + r.randint(1, 30)]))
        docs.append((i if i % 11 else None, "; zz ".join(parts)))
    docs += [(500, None), (501, ""), (502, "..."), (503, items[0][1] * 40), (503, items[0][1] * 40), (504, "x" * 5000 + " " + items[3][1]), (505, "Q q q")]
    return docs, items


def check(rows, docs, items, window):
    got = sorted(((x.doc_id, x.n_words, sum(s["last"] - s["first"] for s in x.spans), list(x["items"])) for x in rows), key=str)
    assert got == brute(docs, items, window)
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(t)
    for x in rows:
        if x.spans:
            assert all(a["last"] < b["first"] for a, b in zip(x.spans, x.spans[1:], strict=False))
            if len(texts[x.doc_id]) == 1:
                body = texts[x.doc_id][0].encode()
                gone = b"".join(body[s["start_byte"]:s["end_byte"]] for s in x.spans)
                assert len(words_of(body[x.spans[0]["start_byte"]:x.spans[0]["end_byte"]].decode())) == x.spans[0]["last"] - x.spans[0]["first"]
                assert len(gone) + len(x.kept.encode()) == len(body)
        else:
            assert x.kept is None


@pytest.mark.parametrize("window,block", [(10, 8 << 20), (3, 8 << 20), (10, 300), (1, 8 << 20)])
def test_same_as_brute_force(spark, window, block):
    docs, items = corpus(random.Random(window))
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, items string").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, words int")
    check(contaminated(d, b, window, block).collect(), docs, items, window)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id string, text string")
    assert [(x.n_words, x.spans, x["items"]) for x in contaminated(d, b).sort("doc_id").collect()] == [(2, [], []), (0, [], [])]
    assert contaminated(d.filter("false"), b.unionByName(b)).count() == 0
    with pytest.raises(ValueError):
        contaminated(d, b, window=0)


def test_long_items_and_documents_lose_no_window(spark):
    r = np.random.default_rng(3)
    words = [f"w{x}" for x in r.integers(0, 3000, 15_000)]
    at = [0, 4090, 4095, 8190, 12_000, 14_990]
    docs = [(i, "zz " + " ".join(words[a:a + 10]) + " zz") for i, a in enumerate(at)] + [(99, " ".join(words * 3))]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"))
    found = {x.doc_id: [(s["first"], s["last"]) for s in x.spans] for x in got.collect()}
    assert found == {**{i: [(1, 11)] for i in range(len(at))}, 99: [(0, 45_000)]}


def test_index_against_plain_search():
    r = np.random.default_rng(1)
    for top in (1, 2, 5, 40):
        symbols = r.integers(0, top + 1, 700)
        symbols[[0, -1]] = 0
        matrix, index = WaveletMatrix(symbols, int(top).bit_length()), FMIndex(symbols, top, step=4)
        at, c = r.integers(0, 701, 50), r.integers(0, top + 1, 50)
        assert matrix.rank(c, at).tolist() == [int((symbols[:i] == x).sum()) for i, x in zip(at, c, strict=True)]
        for m in (1, 2, 4):
            phrases = r.integers(1, top + 1, (30, m))
            for (low, high), p in zip(zip(*index.ranges(phrases), strict=True), phrases, strict=True):
                expected = [i for i in range(700 - m + 1) if (symbols[i:i + m] == p).all()]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == expected


def test_words_of_odd_texts():
    texts = ["AbC-d_9", None, "\x00é\x7fÀ", "", " x"]
    words, bounds = plain_words(pa.array(texts))
    assert [words[a:b].to_pylist() for a, b in zip(bounds, bounds[1:], strict=False)] == [[x.decode() for x in words_of(t)] for t in texts]


def test_query(spark, tmp_path):
    docs, items = corpus(random.Random(77))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in queries.QUERIES["op12_decontamination"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, n, h, len(i), h > 0) for d, n, h, i in brute(docs, items, 10)), key=str)
