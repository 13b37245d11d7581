import numpy as np
import pyarrow as pa

from citegrove.llm.language_id import HashArray, KneserNey, calibrate, fit, gram_counts, predictions, symbols

EN = "the quick brown fox jumps over the lazy dog and then it was all over for the day"
DE = "der schnelle braune Fuchs springt über den faulen Hund und dann war es für heute vorbei"


def labelled(spark):
    rows = [(" ".join(np.random.default_rng(i).permutation(t.split())), lang) for i in range(40) for t, lang in ((EN, "en"), (DE, "de"))]
    return spark.createDataFrame([*rows, (None, "en"), ("", "de"), ("no label", None)], "text string, lang string")


def test_predictions(spark):
    models = calibrate(fit(labelled(spark)), labelled(spark))
    rows = [(1, "the lazy dog", "x"), (2, "über den Hund", "x"), (3, None, "x"), (4, "", "x"), (5, "123 !!", None), (None, "for the day", "x"),
            (6, "the fox\n\n" * 60_000, "x"), (7, "漢字漢字 漢字漢字漢字 漢字漢字漢字 漢字漢字漢字漢字", "x"), (1, "the lazy dog", "x"),
            (8, "🙂🙂", "x"), (9, "𝟏𝟐", "x"), (10, "𠀀𠀁", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = predictions(models, docs).toPandas()
    got = dict(zip(out.doc_id.fillna(-1), zip(out.lang_pred, out.accepted, strict=True), strict=True))
    assert len(out) == 12 and got[1] == ("en", True) and got[2] == ("de", True) and got[-1][0] == "en" and got[6][0] == "en"
    assert all(got[i] == ("und", False) for i in (3, 4, 5, 8, 9)) and not got[7][1] and got[10][0] != "und"
    assert out.score.between(0, 1).all()


def test_nothing_learned_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    models = calibrate(fit(none), none)
    out = predictions(models, spark.createDataFrame([(1, "text")], "doc_id long, text string")).first()
    assert out.lang_pred == "und" and out.score == 0 and predictions(models, none).count() == 0


def test_probabilities_sum_to_one():
    key, _, _ = symbols(pa.array([EN, EN[::-1]], pa.large_string()))
    grams, n = np.unique(key, return_counts=True)
    alphabet = np.unique(grams & np.uint64(0xFFFF))
    model = KneserNey(grams, n, len(alphabet))
    for context in np.unique(grams >> np.uint64(16))[:20]:
        assert abs(model.probability((context << np.uint64(16)) | alphabet).sum() - 1) < 1e-9
    table = HashArray(grams)
    assert (grams[table.order][table.find(grams)] == grams).all() and (table.find(grams + np.uint64(1 << 63)) == -1).all()


def test_pruned_models_keep_the_frequent(spark):
    assert len(fit(labelled(spark), most_grams=50).table.hashes) <= 100


def test_a_rare_language_is_calibrated_in_a_large_table(spark):
    rows = [(f"{EN} {i}x {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "en") for i in range(12_000)]
    df = spark.createDataFrame([*rows, *[(DE, "de")] * 2, ("viele Hunde", "de")], "text string, lang string")
    models = calibrate(fit(labelled(spark)), df)
    assert set(models.limits) == {"de", "en"} and models.limits["de"] != models.limits["en"]
    alone = calibrate(fit(labelled(spark)), df.filter("lang = 'de'")).limits
    assert alone["de"] == models.limits["de"] and alone["en"] == alone["de"]


def test_counts_are_the_same_however_many_a_task_holds(spark):
    docs = labelled(spark).filter("lang IS NOT NULL").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    once, often = (sorted(map(tuple, gram_counts(docs, most_held=n).collect())) for n in (1 << 20, 1))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert once == often and len({x[:2] for x in once}) == len(once) > 100
