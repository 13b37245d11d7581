"""The pipeline against a plain version of each stage on a small table."""
import numpy as np
import public_tokenizers
import pyarrow as pa
from test_jaccard_join import brute
from tokenizers import Tokenizer

import corpus_pipeline
from citegrove.llm.common import stored

EN = "the quick brown fox jumps over the lazy dog and then it was all over for that day in the old town"
DE = "der schnelle braune Fuchs springt über den faulen Hund und dann war es für heute in der Stadt vorbei"


def corpus(spark):
    r = np.random.default_rng(6)
    rows = []
    for i in range(240):
        base = (EN, DE)[i % 3 == 0].split()
        rows.append((i, " ".join(r.choice(base, int(r.integers(30, 90)))), "de" if i % 3 == 0 else "en", "big" if i % 4 else "small", 0))
    rows += [(300, rows[5][1].upper(), "en", "big", 0), (301, rows[6][1] + " tail", None, None, 0), (302, None, "en", "big", 0),
             (303, "", "en", "big", 0), (304, "漢字漢字漢字 漢字漢字漢 漢字漢字漢字漢字漢字", None, "big", 0), (305, "12 34", None, "small", 0), rows[7]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    columns, tokenizer = docs.columns, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, "unused"), name)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        ids = sorted(r.doc_id for r in after)
        if name == "language_id":
            assert ids == sorted(r.doc_id for r in before if r.doc_id not in (302, 303, 304, 305))
        elif name == "exact_dedup":
            keep = {}
            for r in before:
                keep[r.text.lower()] = max(r.doc_id, keep.get(r.text.lower(), -1))
            assert ids == sorted(keep.values()) and 300 in ids and 5 not in ids
        elif name == "jaccard_join":
            labels = brute([(r.doc_id, r.text) for r in before])
            assert ids == sorted(i for i, (c, _) in labels.items() if c == i) and 301 not in ids
        elif name == "mixing":
            assert set(ids) == {r.doc_id for r in before} and len(ids) > len(before)
            assert max(ids.count(i) for i in ids) == 2 and all(ids.count(r.doc_id) == 1 for r in before if r.source == "big")
        else:
            tokens = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
            assert sum(r.length for r in after) == sum(tokens[r.doc_id] for r in before)
            assert all(r.doc_tokens == tokens[r.doc_id] and r.length & (r.length - 1) == 0 for r in after)


def test_empty_table(spark, tmp_path):
    corpus(spark).filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})
    docs = corpus(spark)
    many = spark.range(0, 2_500, 1, 1)
    for name, stage in corpus_pipeline.STAGES:
        if name in ("language_id", "jaccard_join", "packing"):
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            stage(spark, docs, "unused")
            assert many.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] <= 1_000
