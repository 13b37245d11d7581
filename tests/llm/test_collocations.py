import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from citegrove.llm import collocations as c


def brute(rows, most, least, share, top):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i:i + n])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    longer = {}
    for (lang, p), (_, a, _, _) in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i:i + m]] = max(a, longer.get((lang, p[i:i + m]), 0))
    out = []
    for lang in total:
        own = sorted((-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, a, l, r) in found.items()
                     if g == lang and 100 * longer.get((g, p), -1) < share * a)
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(own[:top])]
    return sorted(out)


def corpus(r, rows=300):
    vocabulary = ["a", "The", "the", "New", "york", "é", "çà", "日本", "x\x1fy", "long" * 30, " "] + [f"w{i}" for i in range(30)]
    phrases = ["New York city", "the new york", "a b c d e", "tick\ttock"]
    out = []
    for i in range(rows):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 25))) for _ in range(r.randint(0, 4))] + r.choices(phrases, k=r.randint(0, 3))
        out.append((r.choice(["en", "en", "en", "fr", None, "und", ""]), r.choice([". ", "  ", "\r\n", ",", " \t"]).join(parts)))
    out += [("en", None), ("fr", ""), ("en", " \t.,"), ("en", "x y z " * 4000), ("en", out[0][1]), ("en", out[0][1]), ("de", "only once")]
    return out


@pytest.mark.parametrize("limits", [(3, 10, 50, 2000), (2, 3, 50, 20), (5, 4, 80, 100)])
def test_same_as_brute_force(spark, limits):
    rows = corpus(random.Random(limits[0]))
    df = spark.createDataFrame([(g, t, i, "q") for i, (g, t) in enumerate(rows)], "lang string, text string, block int, phrase string").repartition(3)
    most, least, share, top = limits
    got = sorted(tuple(x) for x in c.collocations(df, most, least, share, top, block_bytes=4000, parts=3).collect())
    assert got == brute(rows, *limits)
    assert got


def test_empty_and_rare(spark):
    df = spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")
    assert c.collocations(df).count() == 0
    assert c.collocations(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        c.collocations(df, most_words=1)


def test_products_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", 1, "a", 4_000_000_000), ("en", 1, "b", 3_999_999_999), ("en", 2, "a b", 3_999_999_998)], "lang string, n int, phrase string, f long")
    assert c.scored(grams).first()["score"] == 10**6 * 3_999_999_998**2 // (4_000_000_000 * 3_999_999_999)


def test_blocks_are_cut_between_pieces(spark):
    text = "one two three. " * 500 + "giant " * 3000
    df = spark.createDataFrame([("en", text)], "lang string, text string")
    blocks = [(zstandard.decompress(x.body), x.n_words) for x in c.text_blocks(df, "text", "lang", 1000).collect()]
    assert b"".join(b for b, _ in blocks).split() == text.replace(".", "").encode().split()
    assert max(len(b) for b, _ in blocks if b"giant" not in b) <= 1000
    assert sum(n for _, n in blocks) == 4500


def test_fingerprints_and_packing():
    body = zstandard.compress("a b c a b c\na b\nc é a b c".encode())
    block = c.Block("en", body)
    one = block.single()
    two = block.longer(2, one)
    three = block.longer(3, two)
    assert sorted(two.count.tolist()) == [1, 1, 1, 3, 4]  # c a, c é, é a, b c, a b
    assert sorted(three.count.tolist()) == [1, 1, 1, 1, 3]
    h = block.fingerprints(np.arange(4), 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 3
    assert c.Block("fr", body).fingerprints(np.arange(1), 3)[0] != h[0]
    wide = block.longer(2, one)
    block.ids = np.concatenate([block.ids, np.zeros(0, np.int64)])
    assert wide.first.tolist() == two.first.tolist()
    x = np.sort(np.random.default_rng(0).integers(0, 2**64, 100, dtype=np.uint64))
    assert (c.unpacked(c.packed(x, True), np.uint64, True) == x).all()
    words = pa.array([b"a", b"", "é".encode()], pa.large_binary())
    assert len(set(c.word_values(words, 5, c.BASE, "fp").tolist())) == 3
