import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citegrove.llm.packing import WordTokenizer, binary_pieces, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello world", "Hello world", "ÉCOLE l'été don't we'll 12 a1b2 <|endoftext|> x", "ΣΑΣ ΟΔΟΣ é  nb sp   İx 漢字 🙂!",
         "a\x1cb \x85c", "***of%%% <|weird|> The THE the\ttab\r\nend", "word " * 30_000 + "x" * 5_000]


def test_pieces_rebuild_every_text(spark):
    rows = [(i if i != 4 else 3, t, "extra") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = pack(docs, PATH).toPandas()
    full = Tokenizer.from_file(PATH)
    assert out.sequence_id.is_unique and (out.offset == 0).all()
    assert set(out.length) <= {1 << k for k in range(13)} and (2 ** out.bucket == out.length).all()
    for i, t in enumerate(TEXTS):
        if i == 4:
            continue
        want = full.encode(t or "", add_special_tokens=False).ids + [2]
        got = out[out.doc_id == i].sort_values(["start", "sequence_id"])
        got = got.drop_duplicates("start") if i == 3 else got
        assert np.concatenate([np.frombuffer(x, "<u4") for x in got.ids]).tolist() == want
        assert (got.doc_tokens == len(want)).all() and got.start.tolist() == (got.length.cumsum() - got.length).tolist()
    assert (out.doc_id == 3).sum() == 2 * len(binary_pieces(3, 4096))


def test_empty_table_and_bad_length(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack(none, PATH).count() == 0
    with pytest.raises(ValueError):
        pack(none, PATH, longest=100)


def test_short_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    assert pack(docs, PATH, longest=4).select(F.sum("length"), F.max("length")).first() == (11, 4)


def test_remembered_words_take_little_memory():
    tokenizer = WordTokenizer(PATH)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in range(2_500)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    tokenizer.encode_rows(data[:5], np.array([0, 5]))
    tracemalloc.start()
    first = tokenizer.encode_rows(data, offsets)[0]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 80 * len(words)
    assert (tokenizer.encode_rows(data, offsets)[0] == first).all()
    assert first.tolist() == Tokenizer.from_file(PATH).encode(" ".join(words), add_special_tokens=False).ids
