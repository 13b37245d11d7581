import numpy as np
import pytest

from citegrove.llm.components import components
from citegrove.llm.jaccard_join import near_duplicates, one_of_each, runs_for


def shingles(text):
    w = [x.lower() for x in (text or "").split()]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    near = {(i, j) for i in sets for j in sets if i != j and sets[i] and sets[j]
            and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    label = {i: i for i in sets}
    for _ in sets:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return {i: (label[i], sum(a == i for a, _ in near)) for i in sets}


def corpus():
    r = np.random.default_rng(9)
    vocabulary = ["".join(r.choice(list("abcdefghij"), 4)) for _ in range(400)]
    rows, passage = [], " ".join(r.choice(vocabulary, 40))
    for g in range(25):
        base = r.choice(vocabulary, int(r.integers(20, 200))).tolist()
        for c in range(int(r.choice([1, 1, 2, 6]))):
            w = list(base)
            for _ in range(c * len(w) // 60):
                w[int(r.integers(len(w)))] = "changed"
            rows.append(" ".join(w) + (" " + passage if g % 3 == 0 else ""))
    rows += [rows[0]] * 4 + [rows[0].upper(), "", None, " \n", "one", "One", "two words", "a b c d e", "A b  c\td e", "a b c d f"]
    base = r.choice(vocabulary, 150).tolist()
    rows += [" ".join([*base[:int(p)], "x", *base[int(p):]]) for p in r.integers(0, 150, 40)]
    return list(enumerate(rows))


@pytest.mark.parametrize("settings", [{}, {"bucket": 5, "most_shingles": 3000}])
def test_same_as_brute_force(spark, settings):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in rows], "doc_id long, text string, id long, n long, component string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(df, **settings).collect()}
    assert got == brute(rows)


def test_one_stays_and_odd_tables(spark):
    rows = corpus()[:30]
    df = spark.createDataFrame([*rows, rows[0], (None, rows[0][1])], "doc_id long, text string")
    left = one_of_each(df).collect()
    labels = brute(rows)
    want = [i for i, _ in rows if labels[i][0] == i]
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted([*want, 0]) and sum(r.doc_id is None for r in left) == 1
    assert near_duplicates(df.filter("false")).count() == 0


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(900, 1000 + i) for i in range(50)]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: label[x] for a, b in edges if a != b for x in (a, b)}
    assert runs_for(0.999, 0.8) > runs_for(0.9, 0.8)


def test_runs_meet_pairs_that_are_split_on_all_levels():
    from citegrove.llm.jaccard_join import LEVELS, runs_for
    met = 1 - (1 - (1 - np.exp(-1)) ** LEVELS) ** runs_for(0.999, 0.8)
    assert met >= 0.999 and runs_for(0.999, 0.8) == 24
