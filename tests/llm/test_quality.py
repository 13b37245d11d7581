import numpy as np

from citegrove.llm.quality import HALF, Network, fit, padded, scores


def rows():
    r = np.random.default_rng(3)
    vocabulary = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(300)]
    good = [" ".join(r.choice(vocabulary, 80)) for _ in range(60)]
    bad = [" ".join(w + "%%%" for w in r.choice(vocabulary, 80)) for _ in range(60)]
    return [(i, t, int(i < 60), None) for i, t in enumerate(good + bad)]


def test_learns_a_held_out_difference(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, label int, score double")
    net = fit(docs, docs.filter("doc_id % 3 <> 0"))
    held = scores(net, docs.filter("doc_id % 3 = 0")).toPandas()
    assert ((held.score >= 0.5) == (held.doc_id < 60)).mean() > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 700_000), (None, "a"), (3, "a"), (4, "a")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, text string, label int")
    net = fit(empty, empty)
    out = scores(net, docs).toPandas()
    assert len(out) == 6 and out.score.between(0, 1).all() and scores(net, empty).count() == 0
    assert out.score[0] == out.score[1] and out.score[3] == out.score[4] == out.score[5]


def test_score_does_not_depend_on_neighbours_and_reads_every_chunk():
    net = Network()
    texts = [b"", b"ab" * 10, b"q" * HALF, b"word " * 5000, b"z"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = net.score(np.frombuffer(b"".join(texts), np.uint8), offsets)
    alone = [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)
    assert padded(np.zeros(0, np.uint8), np.array([0, 0]))[1].tolist() == [1]
    tail = bytearray(texts[3])
    tail[-300:] = b"#!" * 150
    assert net.score(np.frombuffer(bytes(tail), np.uint8), np.array([0, len(tail)]))[0] != alone[3]
